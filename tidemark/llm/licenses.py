"""Licence scan by canonical digests: whole texts, and runs of whole lines of them, are normalised, hashed and joined with known digests."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import kept_columns, private, quoted, ship
from tidemark.llm.license_digests import TEXTS
from tidemark.llm.license_texts import short_texts

#: So many first words of a known text are compared before a run of lines is hashed.
HEAD = 4
#: Before a line that names a copyright owner, on the way to Python; canonical text has no such character.
MARK = "\x01"

#: Notices of public licences, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Spellings of whole words that mean the same, as patterns with replacements, applied in this order to lower-cased text.
SPELLINGS = [
    ("©", "(c)"),
    (r"\blicenc(e|es|ed|ing|ees?|ors?)\b", r"licens\1"),
    (r"\bsub-licens", "sublicens"),
    (r"\bnon-commercial\b", "noncommercial"),
    (r"\bper cent\b", "percent"),
    (r"\bhttp:", "https:"),
    (r"\bversion\b", "v"),
    (r"\bv\.", "v"),
]
#: Lines that name a copyright owner. "(c)" alone may number a clause: a year or the word has to follow.
COPYRIGHT_LINE = r"^[^a-z(]*(copyright|\(c\) *copyright|\(c\)[^a-z]*[0-9]{4}|all rights reserved)"


#: Every match of a pattern in SPELLINGS holds one of these, so texts without any of them stay as they are.
HINTS = ["©", "licenc", "sub-licens", "non-commercial", "per cent", "http:", "version", "v."]


def respelled(text: Column) -> Column:
    low = F.lower(text)
    out = low
    for pattern, new in SPELLINGS:
        out = F.regexp_replace(out, pattern, new.replace("\\1", "$1"))
    return F.when(reduce(Column.__or__, [low.contains(h) for h in HINTS]), out).otherwise(low)


def canonical(text: Column) -> Column:
    """Lower case, one spelling, no copyright lines, and one space for each run of anything but letters a-z, digits and non-ASCII."""
    lines = F.filter(F.split(respelled(text), "\n"), lambda x: ~x.rlike(COPYRIGHT_LINE))
    return plain(F.array_join(lines, "\n"))


def plain(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def described(rows: DataFrame, keep: list[str]) -> DataFrame:
    """license, words, head (first words), digest of the canonical text of rows (license, text), and the columns to keep."""
    words = F.split(canonical(F.col("text")), " ")
    return rows.select("license", F.size(words).alias("words"), F.array_join(F.slice(words, 1, HEAD), " ").alias("head"), F.md5(canonical(F.col("text"))).alias("digest"), *keep)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, words, head, digest of the given texts, or of NOTICES, the short texts of license_texts and the long ones of license_digests.

    Of licences that share a digest the first by name is known; about 250 rows by default.
    """
    rows = described(spark.createDataFrame([*NOTICES, *short_texts()] if texts is None else texts, "license string, text string"), [])
    if texts is None:
        rows = rows.union(spark.createDataFrame(TEXTS, "license string, words int, head string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.first("words").alias("words"), F.first("head").alias("head"))


def _line_licenses(known: list[tuple[str, int, str, str]]):
    """A function of a batch of texts (canonical lines, as bytes): the known texts that are a run of whole lines, with or without the copyright lines between.

    A run must begin with the first words of a known text and end with a line after as many words as that has; only such runs are hashed.
    """
    sizes, names = defaultdict(set), {d: name for name, _, _, d in known}
    for _, n, head, _ in known:
        sizes[head.encode()].add(n)
    firsts = {h.split(b" ", 1)[0] for h in sizes}

    def runs(lines: list[bytes], found: set[str]) -> None:
        before = ends = None
        for j, line in enumerate(lines):
            if line.split(b" ", 1)[0] not in firsts:
                continue
            words = b" ".join(lines[j : j + HEAD]).split(b" ", HEAD)[:HEAD]
            for n in {n for k in range(1, len(words) + 1) for n in sizes.get(b" ".join(words[:k]), ())}:
                if ends is None:
                    before = [0]
                    for x in lines:
                        before.append(before[-1] + x.count(b" ") + 1)
                    ends = {n: k for k, n in enumerate(before)}
                end = ends.get(before[j] + n)
                if end and (name := names.get(hashlib.md5(b" ".join(lines[j:end])).hexdigest())) is not None:
                    found.add(name)

    def find(text: bytes) -> list[str]:
        found, mark = set(), MARK.encode()
        runs(text.replace(mark, b"").split(b"\n"), found)
        if mark in text:
            runs([x for x in text.split(b"\n") if not x.startswith(mark)], found)
        return sorted(found)

    def batch(texts):
        import pyarrow as pa

        return pa.array([find(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    return batch


def scan_licenses(docs: DataFrame, known: DataFrame, bound: int = 100_000) -> DataFrame:
    """docs with digest (of the whole canonical text), license (if that is a known text, else null) and line_licenses (known texts that are a run of whole lines; sorted, distinct).

    known: license, words, head, digest (see known_digests); its digests distinct. Its size is checked against `bound`; then it is
    broadcast for the hash join of whole texts, and sent to the tasks that look up runs of lines: a notice wrapped over lines, or a
    licence inside a longer text, with the copyright lines in it or without. Null or empty text has the digest of the empty text.
    Columns of docs that are named like a result, in any case, are replaced; rows stand alone, so repeated ones get the same answer and
    long texts cost in proportion to their lines; nothing is shuffled; no rows give none.
    """
    table = known.select("license", "words", "head", "digest").limit(bound + 1).collect()
    if len(table) > bound:
        raise ValueError(f"more than {bound} known licence texts")
    keep = kept_columns(docs, ["digest", "license", "line_licenses"])
    digest, marked_ = private(docs, "known_digest", "marked_lines")
    text = F.coalesce("text", F.lit(""))
    marked = F.transform(F.split(respelled(text), "\n"), lambda x: F.concat(F.when(x.rlike(COPYRIGHT_LINE), MARK).otherwise(""), plain(x)))
    rows = docs.select(*map(quoted, keep), F.filter(marked, lambda x: ~x.isin("", MARK)).alias(marked_))
    found = F.arrow_udf(_line_licenses([tuple(r) for r in table]), "array<string>")(F.array_join(marked_, "\n").cast("binary"))
    whole = F.array_join(F.filter(marked_, lambda x: ~x.startswith(MARK)), " ")  # the canonical text: what parts words there is one space
    out = rows.select(*map(quoted, keep), F.md5(whole).alias("digest"), found.alias("line_licenses"))
    names = known.select(F.col("digest").alias(digest), "license")
    return out.join(F.broadcast(names), out["digest"] == names[digest], "left").select(*map(quoted, keep), "digest", "license", "line_licenses")


ship(__name__)
