"""Licence scans by canonical digest lookup (SQL functions only).

A text is brought to a canonical form - lower case, copyright lines and "all
rights reserved" removed, everything but letters and digits turned into single
spaces, equivalent spellings made one - and the SHA-256 of the whole canonical
text is hash-joined to the digests of known licence texts, which go through
the same expressions. Two kinds of unit are looked up, each as an entire text:
the document, and every line of it (a one-line notice such as "Released under
the MIT License." is a known text of its own).

Only digests meet in the join, never texts. The known table is a literal of
fixed size (``KNOWN`` and ``DIGESTS``, or the caller's list of at most
``MAX_KNOWN`` texts), so it is broadcast. ``DIGESTS`` are of full texts too long to
ship, in the forms that wrapping gives them (``tools/build_license_digests.py``).

Defined results: a null text has a null digest and no licence; an empty text,
or one of punctuation only, has the digest of the empty text, which no licence
has; repeated rows give their rows each; an empty table gives an empty result;
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.llm.license_digests import DIGESTS

MAX_KNOWN = 10_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted"""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""

#: Fixed values: (licence, text), public licence texts and the usual notices.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("0BSD", _ISC_GRANT + ". " + _ISC_TAIL),
    ("Zlib", _ZLIB),
    ("BSD-2-Clause", _BSD_HEAD + " " + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + " " + _BSD_THIRD + " " + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
#: Lines that carry no terms.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|&copy;|[0-9]{4}|by )|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$"
RIGHTS = "all rights reserved"
#: Equivalent spellings, after punctuation became spaces: (from, to), in this order.
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"),
    ("favour", "favor"), ("behaviour", "behavior"), ("organisation", "organization"), ("recognise", "recognize"),
    ("fulfilment", "fulfillment"), ("programme ", "program "), ("per cent", "percent"), ("merchantibility", "merchantability"),
]


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    t = F.replace(t, F.lit(RIGHTS), F.lit(""))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(known_digest, license_id), one row per digest (the first licence by name);
    with ``KNOWN`` also the full texts of ``DIGESTS``."""
    full = DIGESTS if known is KNOWN else {}
    if len(known) + sum(map(len, full.values())) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known texts: join them as a table of digests instead")
    one = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("l"), F.lit(t).alias("t")) for i, t in known])).alias("k"))
    out = one.select(digest(F.col("k.t")).alias("known_digest"), F.col("k.l").alias("l"))
    if full:
        lists = F.array(*[F.struct(F.lit(i).alias("l"), F.split(F.lit(" ".join(d)), " ").alias("d")) for i, d in full.items()])
        out = out.unionByName(spark.range(1).select(F.inline(lists)).select(F.explode("d").alias("known_digest"), "l"))
    return out.groupBy("known_digest").agg(F.min("l").alias("license_id"))


def license_scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, unit, digest, license_id: unit -1 is the whole document (always a
    row), unit i >= 0 its i-th line if that is a known text."""
    table = F.broadcast(known_digests(docs.sparkSession, known))  # at most MAX_KNOWN rows
    whole = docs.select("doc_id", F.lit(-1).alias("unit"), digest(F.col("text")).alias("digest"))
    out = whole.join(table, whole["digest"] == table["known_digest"], "left").drop("known_digest")
    # the canonical form is never twice as long as the text, so shorter lines can't be known
    least = min((len(t) for _, t in known), default=0) // 2
    lines = (docs.where(F.length("text") >= least)
             .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("unit", "line"))
             .where(F.length("line") >= least))
    lines = lines.select("doc_id", "unit", digest(F.col("line")).alias("digest"))
    return out.unionByName(lines.join(table, lines["digest"] == table["known_digest"]).drop("known_digest"))
