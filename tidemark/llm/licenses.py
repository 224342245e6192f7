"""License scan (operator 3): canonical digests of whole texts and of their lines.

A text is lower-cased, everything but ASCII letters, digits and line ends becomes
one space, copyright lines go, equivalent spellings become one, and what is left
is joined by single spaces. Its SHA-256 is looked up in the digests of known
licences by a hash join; the same digests of single lines, in the known notices. A
text not found so is looked up by a barer form (`bare`), without copyright lines of
any form, among more licences, with or without titles. The digest given is the first.
All of it is built-in functions; the joins are against tables whose size is fixed in this file, so nothing but the scan grows with the data.

Defined results: a null, empty or punctuation-only text has the digest of the
empty string and no licence; very long texts are digested whole; repeated rows
and columns beyond doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that licence matching holds equal, longer forms first.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
    ("fulfil ", "fulfill "), ("favour", "favor"), ("judgement", "judgment"), ("programme ", "program "), ("recognise", "recognize"), ("wilful", "willful"),
]

# Public licence texts, without their copyright lines.
LICENSES = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE

TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
}

# Notices of one line and the licence that each names.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "All rights reserved.": "all-rights-reserved",
}

OTHER = "[^a-z0-9\n]+"
COPYRIGHT_LINE = "(?m)^ ?(c )?copyright (c |[0-9]).*$"


def canonical_lines(text: Column) -> Column:
    """Canonical form of a text, its lines still apart."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OTHER, " ")
    x = F.regexp_replace(x, COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def canonical_text(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def canonical(text: str) -> str:
    """The same in plain Python, for the tables of known digests."""
    x = re.sub(COPYRIGHT_LINE, "", re.sub(OTHER, " ", text.lower()))
    for old, new in SPELLINGS:
        x = x.replace(old, new)
    return re.sub("[ \n]+", " ", x).strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


# The form in which whole texts are known: besides the above, any copyright line goes
# and lines of reserved rights, and https is http. Java's and Python's syntax.
ANY_COPYRIGHT_LINE = (
    r"(?m)^[^a-z0-9\n\u00a9]*(?:\u00a9|(?:\(c\)|&copy;)[^a-z0-9\n]*(?:copyright|[0-9]{4})"
    r"|copyright(?:[^a-z0-9\n]*(?:\(c\)|&copy;|\u00a9|[0-9]|yyyy|[<\[{]year)|[^a-z0-9\n]+c[^a-z0-9\n]|[^\n]*[^a-z0-9\n](?:19|20)[0-9]{2}(?![0-9]))"
    r"|all rights reserved[^a-z0-9\n]*$)[^\n]*"
)

# Titles a text may or may not have.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense"],
}
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
MORE = {
    "BSD-3-Clause": LICENSES["BSD-2-Clause"].replace("THIS SOFTWARE IS", THIRD + "THIS SOFTWARE IS", 1),
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}

# Digests of long texts, as Debian ships them, whole and up to the end of the terms.
LONG = {
    "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b": "Apache-2.0",
    "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe": "Apache-2.0",
    "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64": "Apache-2.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d": "MPL-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
}


def bare(text: str) -> str:
    """Canonical form of a whole text for the look-up."""
    x = re.sub(OTHER, " ", re.sub(ANY_COPYRIGHT_LINE, "", text.lower()))
    for old, new in [*SPELLINGS, ("https ", "http ")]:
        x = x.replace(old, new)
    return re.sub("[ \n]+", " ", x).strip(" ")


def bare_column(text: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ANY_COPYRIGHT_LINE, ""), OTHER, " ")
    for old, new in [*SPELLINGS, ("https ", "http ")]:
        x = F.replace(x, F.lit(old), F.lit(new))
    return canonical_text(x)


def whole_texts(licenses: dict[str, str]) -> dict[str, str]:
    """Licence of each digest of the bare form: with any title or none, points numbered or not."""
    out = {}
    for k, text in licenses.items():
        titles = TITLES.get(k, [])
        body = next((text[len(t) :] for t in titles if text.startswith(t + "\n")), text)
        for form in (body, re.sub(r"(?m)^[0-9][.] ", "", body)):
            for title in ["", *titles]:
                out[hashlib.sha256(bare(title + "\n" + form).encode()).hexdigest()] = k
    return out


def scan(docs: DataFrame, licenses: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, license_id, notices): notices is a sorted, comma-joined list, empty if there are none."""
    whole = whole_texts(licenses) if licenses else whole_texts(LICENSES | MORE) | LONG
    licenses, notices = licenses or LICENSES, notices or NOTICES
    spark = docs.sparkSession
    known = spark.createDataFrame([(digest(t), k) for k, t in licenses.items()] + [(digest(t), k) for t, k in notices.items()], "canonical_sha256 string, license_id string")
    ids = F.create_map(*[F.lit(v) for t, k in notices.items() for v in (digest(t), k)])
    longest = max(len(canonical(t)) for t in notices)
    texts = spark.createDataFrame(list(whole.items()), "_bare string, _whole string")
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("_lines"), F.sha2(bare_column(F.col("text")), 256).alias("_bare"))
    line = F.filter(F.transform(F.split("_lines", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) <= longest) & (x != ""))  # longer lines equal no notice
    named = F.filter(F.transform(line, lambda x: ids[F.sha2(x, 256)]), lambda x: x.isNotNull())
    rows = lines.select("doc_id", "_bare", F.sha2(canonical_text(F.col("_lines")), 256).alias("canonical_sha256"), F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("notices"))
    rows = rows.join(F.broadcast(known), "canonical_sha256", "left").join(F.broadcast(texts), "_bare", "left")
    return rows.select("doc_id", "canonical_sha256", F.coalesce("license_id", "_whole").alias("license_id"), "notices")


def scan_sql() -> str:
    """The same for DuckDB over the table documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g')"
    text = f"regexp_replace({text}, '(?m)^ ?(c )?copyright (c |[0-9]).*$', '', 'g')"
    for old, new in SPELLINGS:
        text = f"replace({text}, {q(old)}, {q(new)})"
    known = ", ".join(f"({q(digest(t))}, {q(k)})" for k, t in [*LICENSES.items(), *((k, t) for t, k in NOTICES.items())])
    noted = ", ".join(f"({q(canonical(t))}, {q(k)})" for t, k in NOTICES.items())
    return f"""
with c as (select doc_id, {text} as lines from documents),
known(canonical_sha256, license_id) as (values {known}),
noted(line, notice) as (values {noted}),
d as (select doc_id, lines, sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'), ' ')) as canonical_sha256 from c),
l as (select doc_id, trim(unnest(string_split(lines, chr(10))), ' ') as line from c),
n as (select doc_id, string_agg(distinct notice, ',' order by notice) as notices from l join noted using (line) group by doc_id)
select d.doc_id, d.canonical_sha256, known.license_id, coalesce(n.notices, '') as notices
from d left join known on d.canonical_sha256 = known.canonical_sha256 left join n on n.doc_id = d.doc_id
"""
