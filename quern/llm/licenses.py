"""Licence scans: canonical digest lookup.

A text is put into canonical form (lower case, copyright lines dropped, equivalent spellings
unified, punctuation and white space as single spaces), hashed, and hash-joined to the digests
of known licence texts and notices. Matching is of entire texts: the whole document, and each
of its lines, which is how notices stand in documents.

Known texts are a fixed list, whatever the corpus, so their digests are broadcast and the
corpus isn't shuffled; a caller's own list beyond BROADCAST_KNOWN texts is joined by shuffle. The
sentence "All rights reserved." is no licence and reported under the name all-rights-reserved.

Defined results: null, empty and blank texts match nothing; each row of the input reports for
itself, repeated rows repeatedly; an empty table gives no rows; where several licences have one
digest, the first by name is reported; extra columns play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import license_texts
from quern.llm.common import private

#: Known texts up to which their digests (some 100 bytes each) are broadcast.
BROADCAST_KNOWN = 200_000
#: Spellings that count as the same word.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "sub licensing": "sublicensing", "acknowledgement": "acknowledgment", "organisation": "organization", "favour": "favor",
    "honour": "honor", "merchantibility": "merchantability", "non commercial": "noncommercial", "whilst": "while", "wilful": "willful", "fulfil": "fulfill", "percent": "per cent", "http": "https",
}

#: A line that claims copyright.
COPYRIGHT = r"(^|\n)[ \t]*(?:©|\(c\)|copyright[ \t:©(])[^\n]*"

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Licence, and a text or notice that stands for it. Several texts may name one licence.
STATED: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", f"""MIT License

Copyright (c) year holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY}"""),
    ("ISC", """ISC License

Copyright (c) year holder

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n3. {_BSD_3}\n\n{_BSD_TAIL}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n* {_BSD_1}\n\n* {_BSD_2}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n* {_BSD_1}\n\n* {_BSD_2}\n\n* {_BSD_3}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("all-rights-reserved", "All rights reserved."),
]


def _plain_form(text: str) -> str:
    """What canonical() makes of a known text, by which its forms are told apart before Spark sees them."""
    t = re.sub(r"[\W_]+", " ", re.sub(COPYRIGHT, r"\1", text.lower()))
    for other, one in SPELLINGS.items():
        if other in t:
            t = re.sub(rf"(^| ){other}(?=$| )", rf"\1{one}", t)
    return t.strip()


#: STATED, the full texts in spdx/ in their usual forms, notices, and a line for every SPDX identifier.
KNOWN = license_texts.expanded(STATED, _plain_form)


def _spelled(other: str, one: str):
    """Replaces whole words other; a word's end stays to the next word, so that neighbours match too."""
    return lambda x: F.when(F.contains(x, F.lit(other)), F.regexp_replace(x, rf"(^|[ \n]){other}(?:$|([ \n]))", f"$1{one}$2")).otherwise(x)


def canonical(text: Column) -> Column:
    """text in canonical form; line breaks stay where lines are not blank."""
    t = F.lower(text)
    t = F.regexp_replace(t, COPYRIGHT, "$1")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    for other, one in SPELLINGS.items():
        # bound by a lambda, so that the expression doesn't double with every spelling
        t = F.element_at(F.transform(F.array(t), _spelled(other, one)), 1)
    return F.trim(F.regexp_replace(t, r" *\n[ \n]*", "\n"))


def canonical_sql(text: str) -> str:
    """canonical() as DuckDB SQL over an expression."""
    t = f"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT}', '\\1', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for other, one in SPELLINGS.items():
        t = f"regexp_replace({t}, '(^|[ \\n]){other}(?:$|([ \\n]))', '\\1{one}\\2', 'g')"
    return f"trim(regexp_replace({t}, ' *\\n[ \\n]*', chr(10), 'g'))"


def known_digests(df: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the known texts, by the same canonical form."""
    rows = df.sparkSession.createDataFrame(known if known is not None else KNOWN, "license string, text string")
    return rows.select(_digest(canonical(F.col("text"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def _digest(line_or_text: Column) -> Column:
    return F.sha2(F.trim(F.translate(line_or_text, "\n", " ")), 256)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, scope, line, license, digest): each text (scope text, line 0) and line (scope line, from 1) that is a known one.

    Lines are numbered among those that the canonical form leaves.
    """
    line = private("line")
    # bound by a lambda, so that the canonical form is made once and not for the text, its lines and a filter
    units = F.element_at(F.transform(F.array(canonical(F.col(text))), lambda f: F.concat(F.array(f), F.split(f, "\n"))), 1)
    units = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(units).alias("line", line)).filter(F.col(line) != "").withColumn("digest", _digest(F.col(line)))
    digests = known_digests(docs, known)
    few = len(KNOWN if known is None else known) <= BROADCAST_KNOWN
    return units.join(F.broadcast(digests) if few else digests, "digest").select(
        "doc_id", F.when(F.col("line") == 0, "text").otherwise("line").alias("scope"), "line", "license", "digest"
    )
