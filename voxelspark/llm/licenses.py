"""License scans by canonical digest.

A text's canonical form has no copyright lines, lower case, one spelling of words that licences spell in two ways, and neither punctuation nor white space. Its digest is hash-joined to the digests of known licences, so a text is found only if it is a licence as a whole. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Spellings that count as equal in licence texts, the second standing for both.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("cancell", "cancel"), ("capitalis", "capitaliz"), ("categoris", "categoriz"),
    ("centre", "center"), ("customis", "customiz"), ("favour", "favor"), ("finalis", "finaliz"), ("fulfill", "fulfil"), ("honour", "honor"), ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"),
    ("licence", "license"), ("maximis", "maximiz"), ("minimis", "minimiz"), ("modelling", "modeling"), ("optimis", "optimiz"), ("organis", "organiz"), ("practise", "practice"), ("programme", "program"), ("realis", "realiz"),
    ("recognis", "recogniz"), ("serialis", "serializ"), ("unauthoris", "unauthoriz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"), ("https://", "http://"),
)
COPYRIGHT = r"(^|\n)[ \t>*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: What a copyright line has.
MARKS = ("copyright", "(c)", "©", "all rights reserved")
#: ASCII but letters and digits, Latin-1 signs, the block of general punctuation, and two more marks. Single characters below 256 are one look-up in the JVM's regular expressions; ranges are compared one by one.
_SIGNS = [c for c in range(128) if not chr(c).isalnum()] + [0xA0, 0xA9, 0xAB, 0xAE, 0xB7, 0xBB]
PUNCTUATION = "[" + "".join(f"\\x{c:02X}" for c in _SIGNS) + r"\x{2000}-\x{206F}\x{2122}\x{FEFF}]+"

# Public licence texts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_0 = _MIT.replace("do so, subject to the following conditions:", "do so.").split("\n")
_MIT_0 = _MIT_0[0] + "\n" + _MIT_0[2]
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_1 = "\n".join(_BSD.split("\n")[:2])
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
# The texts above, each with its usual titles and without.
LICENSES = tuple(
    (name, lead + text)
    for name, titles, text in (
        ("0BSD", ("Zero-Clause BSD", "BSD Zero Clause License"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
        ("BSD-1-Clause", ("BSD 1-Clause License",), _BSD_1 + "\n" + _BSD_END),
        ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License"), _BSD + "\n" + _BSD_END),
        ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License"), _BSD + "\n" + _BSD_THIRD + "\n" + _BSD_END),
        ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"), _BOOST),
        ("ISC", ("ISC License", "The ISC License"), _ISC + "\n" + _ISC_END),
        ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), _MIT),
        ("MIT-0", ("MIT No Attribution", "MIT-0 License"), _MIT_0),
        ("Unlicense", ("The Unlicense",), _UNLICENSE),
        ("Zlib", ("zlib License", "The zlib License"), _ZLIB),
    )
    for lead in ("", *(t + "\n" for t in titles))
)
# Canonical digests of longer public licences as systems commonly ship them, and, where a text has "END OF TERMS AND CONDITIONS", of the text up to there.
DIGESTS = (
    ("Apache-2.0", "14de5e59ca2d4318ac52f7c036d0b2158e82250410272372c9a552b6ace7eb5f"),
    ("Apache-2.0", "1d5129820031a4000e0f7f846423a81e08fc09dba82aff5bace10fbad75700ce"),
    ("Artistic-1.0-Perl", "fb6f9b6ee3a33f958fe94dc1e9b1ffda1f74a3f8d2377abd8efdd9904a6d07dd"),
    ("BSD-3-Clause", "fad79cba3e77e83e69641bd7d3dd8ee15938439023e379b5bbcc829d32bb49d3"),
    ("CC0-1.0", "490463d4781ed2034b3bbbc660dcd0dd7d1f4c2395fac855079030adbaf9b8ec"),
    ("GFDL-1.2", "21083399c050f0109b0753c98f6f796f924ac7e5cd60e72044e66a716e281a77"),
    ("GFDL-1.3", "b5db45ce7ae24a5f4c7b290cc0d2844e0db79c157be4fcef51b99e32c7510d1d"),
    ("GPL-1.0", "d8785135070290aef41fd8427be4a7a38773acd88b7e9ccb7e93dc3af324d933"),
    ("GPL-1.0", "0fd74e6f24738ca0c19c7a9868b74d7ce88749df0e6c8637712f9464fa5bf2aa"),
    ("GPL-2.0", "a07c2c4f7cd250a6693d15fe478f83d937db15854f872d2e63102028ac18a482"),
    ("GPL-2.0", "7fa59f8821203340bbb2c3544a069b8e9054dede930e574f4f53fd1f326b1639"),
    ("GPL-3.0", "22f45b6cdc3ff39b9717203cbf76bcdaa8b9b48ad7dc9e8dd82f180c688700bd"),
    ("GPL-3.0", "25cb601b89be72503febf6177d1a2847684faa8e24ef09babc26a0b69147920f"),
    ("LGPL-2.0", "732004013d269ff5b3f32bc5fdfd67ee69bb78ad970b2cd00f1ad7184ebaec07"),
    ("LGPL-2.0", "a45a8e2e9a46fafcd9d4dcbabbb1d856b5d2437981e062bf126516a4979d79be"),
    ("LGPL-2.1", "be7d8817628491fa143503f71de80f7e637c8f9aaa264e95e38e6fc2d5035748"),
    ("LGPL-2.1", "6a3f7c41fc208f93b3261feaffd6e0b7505b1953cf528928874fb3a04e95042c"),
    ("LGPL-3.0", "9da940a5cdd0ef8c6da67bf24cbe851115f32bfcb87aa56b7dec93a85f943e6d"),
    ("MPL-1.1", "fb45b649c065edba3e022706dfb10b77ce10632dba510516994b6ecc9f5a77e6"),
    ("MPL-2.0", "71146a0d6e9425b18dd5d6a1b5141eab309c03ea4fae946eadfb5d069de504eb"),
)
#: A table of known digests of up to so many rows is broadcast.
SMALL = 100_000


def canonical(text: Column) -> Column:
    """The text that is hashed. Copyright lines are sought only where a text has one of their ``MARKS``, and a spelling is replaced only where it occurs, as both checks are cheaper."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EQUIVALENT))

    def body(low: Column) -> Column:
        marked = F.lit(False)
        for mark in MARKS:
            marked = marked | low.contains(mark)
        out = F.when(marked, F.regexp_replace(low, COPYRIGHT, "\n")).otherwise(low)
        return F.aggregate(pairs, out, lambda t, p: F.when(t.contains(p["a"]), F.replace(t, p["a"], p["b"])).otherwise(t))

    once = F.get(F.transform(F.array(F.lower(text)), body), F.lit(0))  # the body names its argument several times
    return F.regexp_replace(once, PUNCTUATION, "")


def read_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """license_id and text of the files of a folder, one text a file, named by its license_id with or without ".txt"."""
    files = spark.read.text(folder, wholetext=True)
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/]*?)(\.txt)?$", 1)
    return files.select(name.alias("license_id"), F.col("value").alias("text"))


def known_digests(spark: SparkSession, licenses=LICENSES, digests=DIGESTS) -> DataFrame:
    """license_id and digest of each known text; of several with one digest, the least license_id. ``licenses`` is a sequence of (license_id, text) or a DataFrame of them; ``digests`` is a sequence of (license_id, canonical digest) of texts known by those alone."""
    texts = licenses if isinstance(licenses, DataFrame) else spark.createDataFrame(list(licenses), "license_id string, text string")
    told = texts.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    if digests:
        told = told.union(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return told.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses=LICENSES, text: str = "text", doc_id: str = "doc_id", digests=DIGESTS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, digest of the canonical text, and license_id (null if the text is no known licence). ``licenses`` and ``digests`` are as in ``known_digests``; a DataFrame (``read_licenses``) is joined as its size asks.

    Null text: null digest and license_id. Empty texts, and those of punctuation and copyright lines only, have the digest of nothing, which no licence has. Texts of any length are taken whole, a text in one task. Repeated rows and null ids stay as they are; an empty table gives an empty result; other columns are left out.
    """
    known = known_digests(docs.sparkSession, licenses, digests)
    known = known if isinstance(licenses, DataFrame) or len(licenses) + len(digests) > SMALL else F.broadcast(known)
    told = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("digest"))
    return told.join(known, "digest", "left").select("doc_id", "digest", "license_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower({text}), {quote(COPYRIGHT)}, chr(10), 'g')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    return f"sha256(regexp_replace({out}, {quote(PUNCTUATION)}, '', 'g'))"


def _values(pairs) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(a)}, {quote(b)})" for a, b in pairs)


OP8_SQL = f"""
WITH known AS (SELECT min(license_id) AS license_id, digest FROM (SELECT license_id, {_sql("text")} AS digest FROM (VALUES {_values(LICENSES)}) AS v(license_id, text) UNION ALL FROM (VALUES {_values(DIGESTS)})) GROUP BY digest),
told AS (SELECT doc_id, {_sql("text")} AS digest FROM documents)
SELECT t.doc_id, t.digest, k.license_id FROM told t LEFT JOIN known k ON t.digest = k.digest
"""
