"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's passages are its lines with a licence cue, the sentences of these, and windows of several
lengths over each run of such lines with two lines around, so that wrapped headers and notices inside
long lines are met. Copyright lines are no part of them. The words of a passage and of each template
are weighted ``tf * idf``, with idf over the templates, and each passage is compared by cosine. A template
counts only where the passage holds the words that tell its licence from its kin (``REQUIRED``: version,
ShareAlike, Affero, number of clauses). The best passage at or above the threshold gives the file's own
licence; where no template's words are met it is ``unknown``, and "all rights reserved" counts only where
nothing else is found. Of a licence file (by its name) the whole text is compared with full licence texts
first (``licence_texts``), then its first lines, then all passages. SPDX
identifiers are taken as they are (cosine 1), with ``-only``, ``-or-later`` and ``+`` left out.

A licence file's licence belongs to its directory. A file without a licence of its own takes that
of the nearest ancestor directory which has one: each distinct directory joins its ancestors by
path, the deepest match wins, and files then join their own directory.

Defined results: a null text has no notice; a null path or directory part is the empty part; of
several licence files in a directory the highest cosine wins, then the first path; of templates
with equal cosine the first by name. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Query, small_batches, table

THRESHOLD = 0.5
#: Lines with one of these are part of a notice.
CUE = r"(?i)licen[cs]e|copyright|spdx|all rights reserved|permission is hereby granted|redistribution and use|public domain"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
#: Notices as their licences suggest them, in short.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
    "Apache-2.0 (short)": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (program)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MIT (short)": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Apache-2.0 (title)": "Apache License Version 2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause (short)": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause (short)": "Licensed under the BSD 3-Clause License.",
    "BSD-4-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "Creative Commons CC0 1.0 Universal Public Domain Dedication. To the extent possible under law, the author has waived all copyright and related rights.",
    "CC0-1.0 (short)": "Licensed under CC0 1.0 Universal.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",
    "ISC (short)": "Released under the ISC License.",
    "MIT (title)": "MIT License",
    "MPL-2.0 (title)": "Mozilla Public License Version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense (short)": "Released under the Unlicense.",
}
_GNU = {"GPL": ("", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser ", ("2.0", "2.1", "3.0")), "AGPL": ("Affero ", ("3.0",))}
for _short, (_kind, _versions) in _GNU.items():
    for _v in _versions:
        _name, _n = f"{_short}-{_v}", _v.removesuffix(".0")
        TEMPLATES.setdefault(_name, f"This work is licensed under the GNU {_kind}General Public License, version {_n}.")
        TEMPLATES.setdefault(f"{_name} (program)", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License, version {_n}.")
        TEMPLATES[f"{_name} (published)"] = f"under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation, either version {_n} of the License, or (at your option) any later version."
        TEMPLATES[f"{_name} (title)"] = f"GNU {_kind}General Public License Version {_n}"
        TEMPLATES[f"{_name} (short)"] = f"Licensed under {_short}v{_n}."
        TEMPLATES[f"{_name} (id)"] = f"License: {_name}"
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _kind in _CC.items():
    for _v in ("3.0", "4.0"):
        TEMPLATES.setdefault(f"CC-{_short}-{_v}", f"Licensed under CC {_short} {_v}.")
        TEMPLATES[f"CC-{_short}-{_v} (long)"] = f"This work is licensed under a Creative Commons {_kind} {_v} International License."
        TEMPLATES[f"CC-{_short}-{_v} (id)"] = f"Licensed under CC-{_short}-{_v}."
for _v in ("1.0", "2.0"):
    TEMPLATES[f"EPL-{_v}"] = f"This program is made available under the terms of the Eclipse Public License {_v}"
    TEMPLATES[f"EPL-{_v} (title)"] = f"Eclipse Public License - v {_v}"

_NO_MORE = r"(?!\d|\.\d)"


def _gnu(kind: str, short: str, version: str) -> str:
    v = re.escape(version.removesuffix(".0")) + (r"(?:\.0)?" if version.endswith(".0") else "") + _NO_MORE
    name = rf"(?:gnu {kind}general public licen[cs]e|(?<![a-z]){short})"
    return rf"{name}(?:(?!\d|lesser|library|affero|gnu).){{0,90}}?{v}|version {v} of the {name}"


_BSD = r"redistribution and use in source and binary forms"
#: What the words of a passage must match; {licence: (in the passage, and in the whole text, and not there)}, any of these.
REQUIRED: dict[str, list[tuple[str, str, str]]] = {
    "Apache-2.0": [(r"\bapache\b.{0,40}?(?<![\d.])2(?:\.0)?" + _NO_MORE, "", "")],
    "BSD-2-Clause": [(r"\b(?:2|two)[- ]clause|bsd-2|simplified bsd", "", ""), (_BSD, "redistributions in binary form", r"neither the name|may not be used to endorse|advertising materials")],
    "BSD-3-Clause": [(r"\b(?:3|three)[- ]clause|bsd-3|(?:new|modified|revised) bsd", "", ""), (_BSD, r"neither the name|may not be used to endorse", "advertising materials")],
    "BSD-4-Clause": [(r"\b(?:4|four)[- ]clause|bsd-4", "", ""), (_BSD, "advertising materials", "")],
    "BSL-1.0": [(r"boost software licen[cs]e.{0,12}?1\.0" + _NO_MORE, "", "")],
    "CC0-1.0": [(r"\bcc0\b|creative commons zero", "", "")],
    "ISC": [(r"\bisc licen[cs]e|with or without fee is hereby granted provided", "", "")],
    "MIT": [(r"\bmit\b(?!-)|permission is hereby granted free of charge", "", "")],
    "MPL-2.0": [(r"mozilla public licen[cs]e.{0,12}?(?<![\d.])2(?:\.0)?" + _NO_MORE, "", "")],
    "Proprietary": [("all rights reserved", "", "")],
    "Unlicense": [(r"\bunlicen[cs]e\b|free and unencumbered software", "", "")],
}
for _short, (_kind, _versions) in _GNU.items():
    for _v in _versions:
        REQUIRED[f"{_short}-{_v}"] = [(_gnu("(?:lesser |library )" if _short == "LGPL" else _kind.lower(), _short.lower(), _v), "", "")]
for _short, _kind in _CC.items():
    for _v in ("3.0", "4.0"):
        _words = re.sub(r"-", "[- ]", _kind.lower()).replace("noncommercial", "non-?commercial").replace("sharealike", "share-?alike").replace("noderivatives", "no-?deriv(?:ative)?s")
        REQUIRED[f"CC-{_short}-{_v}"] = [(rf"(?:creative commons {_words}|\bcc[- ]{_short.lower()})(?: international| unported| version| v| licen[cs]e)*[- ]{re.escape(_v)}", "", "")]
for _v in ("1.0", "2.0"):
    REQUIRED[f"EPL-{_v}"] = [(rf"eclipse public licen[cs]e.{{0,14}}?(?<![\d.]){re.escape(_v)}", "", "")]
#: The cosine from which a whole text counts as a full licence text.
FULL = 0.9


@cache
def full_texts() -> dict[str, str]:
    """Full licence texts, by licence."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def distinguished(licence: str, passage: str, whole: str) -> bool:
    """Whether the words of a passage, and of the text it is of, are those of the licence and of no kin of it."""
    ways = REQUIRED.get(licence)
    return ways is None or any(re.search(a, passage) and (not b or re.search(b, whole)) and not (c and re.search(c, whole)) for a, b, c in ways)
#: Words of which a window holds one at least.
CUE_WORD = re.compile(r"licen[cs]|unlicen|copyright|rights$|permission$|redistribution$|domain$|gpl|lgpl|agpl")
WINDOWS = (6, 9, 13, 19, 28, 42)
SPDX = re.compile(r"(?i)spdx-licen[cs]e-identifier\s*:\s*([^\r\n]*)")
_SPDX_PART = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
_COPYRIGHT = re.compile(r"(?i)^[^\w(\u00a9]*(?:copyright\b(?!\s+(?:notice|holder|owner|licen|law|and|interest|statement|disclaimer))|\(c\)\s*\d|\u00a9).*?(?=all rights reserved|(?:released|licen[cs]ed|distributed|available|provided) under|$)")
_CUE = re.compile(CUE)
_LICENCE_FILE = re.compile(LICENCE_FILE)


def tokens(text: str) -> list[str]:
    """Lower-case words; dots and hyphens stay inside words and go from their ends."""
    return [w for w in (x.strip(".-") for x in re.split(r"[^\w.\-]+|_", text.lower())) if w]


def template_weights(templates: dict[str, str] = TEMPLATES) -> tuple[dict[str, float], list[tuple[str, str, float]], float]:
    """idf of the templates' words, (template, word, weight of the normalised vector), idf of all other words."""
    words = {name: tokens(text) for name, text in templates.items()}
    n = len(words)
    idf = {w: math.log((1 + n) / (1 + sum(w in x for x in words.values()))) + 1 for x in words.values() for w in x}
    out = []
    for name, own in words.items():
        vector = {w: own.count(w) * idf[w] for w in own}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        out += [(name, w, x / norm) for w, x in sorted(vector.items())]
    return idf, out, math.log(1 + n) + 1


def spdx_licence(expression: str, names: dict[str, str]) -> str | None:
    """The licence of an SPDX expression; names: of known identifiers in lower case."""
    out, ids = [], 0
    for part in _SPDX_PART.findall(expression):
        if part in "()" or part.upper() in ("AND", "OR", "WITH"):
            out.append(part.upper())
            continue
        if out and out[-1] not in ("(", "AND", "OR", "WITH"):
            break  # what follows is no part of the expression
        base = re.sub(r"(?i)(-only|-or-later|\+)$", "", part.rstrip(".-:"))
        out.append(names.get(base.lower(), base))
        ids += 1
    while out and (out[-1] in ("AND", "OR", "WITH", "(") or out[-1] == ")" and out.count(")") > out.count("(")):
        out.pop()
    text = " ".join(out).replace("( ", "(").replace(" )", ")")
    return (text[1:-1] if ids == 1 and text.startswith("(") and text.endswith(")") else text) if ids else None


def passages(text: str) -> list[list[str]]:
    """Words of the cue lines, of their sentences and of the windows around, without copyright lines."""
    lines = [_COPYRIGHT.sub("", x) for x in text.split("\n")]
    cued = [i for i, x in enumerate(lines) if _CUE.search(x)]
    out = []
    for i in cued:
        out.append(tokens(lines[i]))
        parts = re.split(r"(?<=[.;:!?])\s+", lines[i])
        out += [tokens(x) for x in parts if len(parts) > 1 and _CUE.search(x)]
    near = sorted({k for i in cued for k in range(max(0, i - 2), min(len(lines), i + 3))})
    runs: list[list[str]] = []
    for k, i in enumerate(near):
        if not k or near[k - 1] != i - 1:
            runs.append([])
        runs[-1] += tokens(lines[i])
    for words in runs:
        at = [i for i, w in enumerate(words) if CUE_WORD.search(w)]
        for size in WINDOWS:
            step = 1 + size // 5
            starts = {k * step for i in at for k in range(max(0, -(-(i - size + 1) // step)), i // step + 1)}
            out += [words[k : k + size] for k in sorted(starts)]
    return [list(x) for x in dict.fromkeys(tuple(x) for x in out if x)]


#: Licences that count only where no other is found.
RANK = {"unknown": 1, "Proprietary": 2}


class Matcher:
    """Compares passages with templates, and licence files with full texts."""

    def __init__(self, templates: dict[str, str], threshold: float, texts: dict[str, str] | None = None):
        self.full = Matcher(texts, FULL) if texts else None
        self.idf, weights, self.other = template_weights(templates)
        self.threshold = threshold
        self.of_word: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for name, word, weight in weights:
            self.of_word[word].append((name, weight))
        self.licence = {name: re.sub(r" \(.*", "", name) for name in templates}
        self.names = {x.lower(): x for x in self.licence.values()}

    def cosines(self, words: list[str]) -> list[tuple[float, str]]:
        """(cosine, licence) of the templates that reach the threshold."""
        dot: dict[str, float] = defaultdict(float)
        square = 0.0
        for word, tf in Counter(words).items():
            x = tf * self.idf.get(word, self.other)
            square += x * x
            for name, weight in self.of_word.get(word, ()):
                dot[name] += x * weight
        norm = math.sqrt(square)
        return [(c, self.licence[name]) for name, x in dot.items() if (c := round(x / norm, 9)) >= self.threshold]

    def best(self, path: str, text: str) -> tuple[str, float] | None:
        """Licence and cosine of one file."""
        named = sorted({x for m in SPDX.finditer(text) if (x := spdx_licence(m[1], self.names))})
        if named:
            return " AND ".join(f"({x})" if " OR " in x and len(named) > 1 else x for x in named), 1.0
        whole = tokens("\n".join(_COPYRIGHT.sub("", x) for x in text.split("\n")))
        joined = " ".join(whole)
        if _LICENCE_FILE.search(path):
            if self.full:
                head = " ".join(whole[:60])
                found = [(-c, x) for c, x in self.full.cosines(whole) if distinguished(x, joined if x.startswith(("BSD", "MIT", "ISC")) else head, joined)]
                if found:
                    return min(found)[1], -min(found)[0]
            found = self.found(passages("\n".join(text.split("\n")[:12])), joined)
            if found and found[0] == 0:
                return found[2], -found[1]
        tried = passages(text)
        if _LICENCE_FILE.search(path):
            tried.append(whole)
        found = self.found(tried, joined)
        return (found[2], -found[1]) if found else None

    def found(self, tried: list[list[str]], whole: str) -> tuple[int, float, str] | None:
        """Rank, -cosine and licence of the best of the passages."""
        out = []
        for words in tried:
            near = self.cosines(words)
            if near:
                passage = " ".join(words)
                told = [(RANK.get(x, 0), -c, x) for c, x in near if distinguished(x, passage, whole)]
                named = [c for c, x in near if x != "Proprietary"]
                out += told or [(RANK["unknown"], -c, "unknown") for c in sorted(named)[-1:]]
        return min(out, default=None)


def own_licences(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, licence, cosine of each path of files (path, text) with a passage that reaches the threshold."""
    matcher = Matcher(templates, threshold, full_texts())  # as large as the templates

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = [(path, *b) for path, text in pairs if (b := matcher.best(path, text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["path", "licence", "cosine"])

    small_batches(files.sparkSession)
    found = files.where(F.col("text").rlike(CUE)).select("path", "text").mapInArrow(match, "path string, licence string, cosine double")
    best = found.groupBy("path").agg(F.min(F.struct(F.when(F.col("licence") == "Proprietary", RANK["Proprietary"]).when(F.col("licence") == "unknown", RANK["unknown"]).otherwise(0).alias("p"), (-F.col("cosine")).alias("c"), "licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    """The path without its last part; the empty string at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (path, text and more) with licence, cosine, origin and licence_dir instead of text.

    origin: own, inherited or none. licence_dir: the directory inherited from.
    """
    files = files.withColumn("path", F.coalesce("path", F.lit("")))
    own = own_licences(files.select("path", "text"), templates, threshold)
    declared = (
        own.where(F.col("path").rlike(LICENCE_FILE)).groupBy(directory(F.col("path")).alias("licence_dir"))
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path"), F.col("licence"))).alias("b"))
        .select("licence_dir", F.col("b.licence").alias("dir_licence"), (-F.col("b.c")).alias("dir_cosine"))
    )
    dirs = files.select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/", -1)
    ancestors = F.array_append(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.array_join(F.slice(parts, 1, k), "/")), F.lit(""))
    nearest = (
        dirs.select("dir", F.explode(F.array_distinct(ancestors)).alias("licence_dir")).join(declared, "licence_dir")
        .groupBy("dir").agg(F.max(F.struct(F.length("licence_dir").alias("depth"), "licence_dir", "dir_licence", "dir_cosine")).alias("b"))
        .select("dir", "b.licence_dir", "b.dir_licence", "b.dir_cosine")
    )
    out = files.drop("text", "licence", "cosine", "dir").withColumn("dir", directory(F.col("path"))).join(own, "path", "left").join(nearest, "dir", "left")
    has = F.col("licence").isNotNull()
    return out.select(
        *[c for c in files.columns if c not in ("text", "licence", "cosine", "dir")],
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.coalesce("cosine", "dir_cosine").alias("cosine"),
        F.when(has, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("licence_dir")).alias("licence_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source, then blocks of 1,000 and of 50 ids; every tenth id is its directory's LICENSE."""
    n = F.coalesce(F.col("doc_id"), F.lit(-1).cast("long"))
    name = F.when(n % 10 == 0, F.concat(F.lit("LICENSE-"), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    block = lambda size: F.floor(n / F.lit(size)).cast("string")
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("")), block(1000), block(50), name).alias("path"))


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_paths(table(spark, sf_dir, "documents"))).select("doc_id", "path", "licence", "cosine", "origin", "licence_dir")


QUERIES: dict[str, Query] = {"op1_licence_scan": op1_licence_scan}
