"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

The vectoriser is fitted on the templates. Headers are compared to short notices, whole texts to the notices and to the
licences' own whole texts; what a unit states of version and variant must agree with the licence, and a unit that says
that something is not licensed so bears none. Every line and every run of lines without a blank one is a header unit of
its document; the whole text is the unit that makes a document a licence file. A document without a licence of its own
inherits that of the nearest directory above it that holds a licence file: directories (not documents) are joined to
their ancestors' paths. Texts are scanned once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch, annotate, fresh_names

#: Cosine from which a unit bears a template's licence: headers, whole texts to notices, and to whole licence texts.
HEADER, FILE, FILE_TEXT = 0.75, 0.6, 0.8
#: Notices that public licences ask for or are known by.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "EPL-2.0": [
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "GPL-2.0-only": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2.",
    ],
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0-only": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "LGPL-2.1-only": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    ],
    "LGPL-3.0-only": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
    ],
    "BSD-3-Clause": ["BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Directories with a licence that are broadcast (a path and a name each); beyond, documents are joined by a salted shuffle.
BROADCAST_DIRECTORIES, SALTS = 100_000, 32
#: Names of SPDX that older files use, by what they are called here; all names are told apart without case.
SPDX_NAMES = {n.lower(): n for n in (*TEMPLATES, "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later")}
SPDX_NAMES |= {f"{f}-{v}{mark}".lower(): f"{f}-{v}-{kind}" for f, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for mark, kind in (("", "only"), ("+", "or-later"))}
_SPDX = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+-]*\)*(?:[ \t]+(?-i:AND|OR|WITH)[ \t]+\(*[a-z0-9][a-z0-9.+-]*\)*)*)").search
_COPYRIGHT = re.compile(r"(?i)[^a-z0-9(©]*(?:copyright\b|\(c\)|©|all rights reserved|spdx-)").match
_DENIES = re.compile(r"\b(?:not|never|no longer|isn't|aren't|wasn't)\s+(?:\w+\s+){0,2}?(?:licen[sc]ed|released|distributed|available|offered|covered|published|under)\b").search
_WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*").findall
_VERSION = re.compile(r"(?:[al]?gpl)?v?([0-9](?:\.[0-9]+)*)").fullmatch
#: Words that state a variant, by what the names of a family's licences hold for it.
VARIANTS = {
    "GPL": {"AGPL": {"affero", "agpl", "agplv3"}, "LGPL": {"lesser", "library", "lgpl", "lgplv2", "lgplv2.1", "lgplv3"}, "later": {"later"}},
    "CC-BY": {"-NC": {"nc", "noncommercial", "commercial"}, "-SA": {"sa", "sharealike", "alike"}, "-ND": {"nd", "noderivatives", "noderivs", "derivatives"}},
}


def licence_texts() -> dict[str, str]:
    """Whole texts of licences by name; read on the driver."""
    folder = resources.files("groundspark.llm") / "licence_texts"
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    # the Affero licence is the general one but for its name and a section
    texts["AGPL-3.0-only"] = re.sub("(?i)GNU General Public", "GNU Affero General Public", texts["GPL-3.0-only"])
    # the variants of Creative Commons are told apart by their titles
    for variant in ("", "-NC", "-ND", "-NC-SA", "-NC-ND"):
        texts[f"CC-BY{variant}-4.0"] = texts["CC-BY-SA-4.0"]
    return texts


def _versions(terms) -> set[str]:
    return {m[1].removesuffix(".0") for m in map(_VERSION, terms) if m}


def agrees(name: str, terms, must_state: bool = True) -> bool:
    """Whether version and variant in the terms are those of the licence; without must_state a version can be missing."""
    own = re.search(r"-([0-9]+\.[0-9]+)", name)
    found = _versions(terms)
    if own and (found or must_state) and own[1].removesuffix(".0") not in found:
        return False
    if "clause" in terms and name.startswith("BSD-") and found and name[4] not in found:
        return False
    for family, variants in VARIANTS.items():
        if family in name and any((mark in name) == words.isdisjoint(terms) for mark, words in variants.items()):
            return False
    return True


class Templates:
    """TF-IDF vectors of the templates: weight of a term is its count times ln((1 + N) / (1 + df)) + 1; unit length."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        rows = [(name, Counter(_WORDS(text.lower()))) for name, texts in templates.items() for text in texts]
        self.names = [name for name, _ in rows]
        df = Counter(t for _, terms in rows for t in terms)
        self.idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}
        self.unseen = math.log(1 + len(rows)) + 1
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, (_, terms) in enumerate(rows):
            norm = math.sqrt(sum((c * self.idf[t]) ** 2 for t, c in terms.items()))
            for t, c in terms.items():
                self.postings.setdefault(t, []).append((i, c * self.idf[t] / norm))
        # terms of few templates; a unit without one shares too little for a cosine of 0.5
        self.telling = {t for t, n in df.items() if n <= max(1, len(rows) // 4)} or set(df)

    def best(self, terms: Counter, least: float = 0.0, fits=None) -> tuple[str | None, float]:
        """Nearest template's name and cosine; of equal ones the first in order of name.

        With fits (a function of names) only templates that fit count, and none below the cosine least.
        """
        norm, dots = 0.0, {}
        for t, c in terms.items():
            w = c * self.idf.get(t, self.unseen)
            norm += w * w
            for i, v in self.postings.get(t, ()):
                dots[i] = dots.get(i, 0.0) + w * v
        if not dots:
            return None, 0.0
        if fits:
            dots = {i: dot for i, dot in dots.items() if dot / math.sqrt(norm) >= least and fits(self.names[i])}
            if not dots:
                return None, 0.0
        i, dot = min(dots.items(), key=lambda x: (-round(x[1], 12), self.names[x[0]]))
        return self.names[i], dot / math.sqrt(norm)


class LicenceTexts:
    """TF-IDF vectors of whole licence texts; a term counts 1 + ln of its count, so that common words don't rule."""

    def __init__(self, texts: dict[str, str]) -> None:
        rows = {}
        for name, text in texts.items():
            rows.setdefault(text, []).append(name)
        self.names = list(rows.values())
        terms = [Counter(_WORDS(text.lower())) for text in rows]
        df = Counter(t for x in terms for t in x)
        self.idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}
        self.unseen = math.log(1 + len(rows)) + 1
        self.vectors = [self._weights(x) for x in terms]
        self.least = 0
        if rows:
            needed = []
            for v in self.vectors:
                norm = math.sqrt(sum(w * w for w in v.values()))
                for t in v:
                    v[t] /= norm
                masses = np.cumsum(sorted((w * w for w in v.values()), reverse=True))
                needed.append(int(np.searchsorted(masses, FILE_TEXT**2)))
            # the cosine is at most the length of the text's part that is shared: fewer terms can't reach the threshold
            self.least = min(needed)

    def _weights(self, terms: Counter) -> dict[str, float]:
        return {t: (1 + math.log(c)) * self.idf.get(t, self.unseen) for t, c in terms.items()}

    def best(self, terms: Counter, lines: list[str]) -> tuple[str | None, float]:
        """Name and cosine of the nearest licence that agrees with the title and reaches FILE_TEXT. What stands in front of
        the title may be a preface: the text from the title on is compared, too."""
        if not self.idf or len(self.idf.keys() & terms.keys()) < self.least:
            return None, 0.0
        at, title = title_of(lines)
        found = self._near(terms, title)
        if at:
            found += self._near(Counter(w for line in lines[at:] for w in _WORDS(line.lower())), title)
        return (min(found)[1], -min(found)[0]) if found else (None, 0.0)

    def _near(self, terms: Counter, title: set[str]) -> list[tuple[float, str]]:
        own = self._weights(terms)
        norm = math.sqrt(sum(w * w for w in own.values()))
        found = []
        for names, v in zip(self.names, self.vectors, strict=True):
            cosine = sum(w * v[t] for t, w in own.items() if t in v) / norm
            if cosine >= FILE_TEXT:
                found += [(-round(cosine, 12), name) for name in names if self._fits(name, title, terms)]
        return found

    @staticmethod
    def _fits(name: str, title: set[str], terms: Counter) -> bool:
        if name.startswith("BSD-"):
            return ("endorse" in terms) == (name == "BSD-3-Clause") and "advertising" not in terms
        # without a title the text alone tells the GNU licences apart, and none of the Creative Commons variants
        return agrees(name, title, False) if title else not name.startswith("CC-BY")


def title_of(lines: list[str]) -> tuple[int, set[str]]:
    """Place of the first line that names a licence, and the words of it and of the next one; 0 and none without one."""
    for k, line in enumerate(lines):
        words = set(_WORDS(line.lower()))
        if not words.isdisjoint({"license", "licence", "attribution", "legal"}) and "permission" not in words:
            return k, words.union(*(_WORDS(x.lower()) for x in lines[k + 1 : k + 2]))
    return 0, set()


def spdx(text: str) -> str | None:
    """The first SPDX-License-Identifier expression of a text, in the names used here; null without one, or if it says
    that there is none. Names that aren't known stay as they are."""
    found = _SPDX(text)
    if not found or found[1].upper() in ("NONE", "NOASSERTION"):
        return None
    parts = re.split(r"([()\s]+)", found[1])
    said = "".join(SPDX_NAMES.get(p.lower(), p) for p in parts).strip()
    return said + ")" * (said.count("(") - said.count(")"))


def own_licences(texts: list[str | None], templates: Templates, licences: LicenceTexts) -> list[tuple]:
    """(header licence, cosine, file licence, cosine, all header licences in order of name) of each text; the best unit at or
    above the threshold. An SPDX expression is the header, whatever else is there. Lines of copyright belong to no unit
    but their own."""
    out = []
    for text in texts:
        header, score, every = None, 0.0, set()
        whole: Counter = Counter()
        block: Counter = Counter()
        lines: list[str] = []
        prose: list[str] = []
        for line in [*(text or "").split("\n"), ""]:
            terms = Counter(_WORDS(line.lower()))
            units = []
            if terms:
                units = [(terms, line)]
                if not _COPYRIGHT(line):
                    block.update(terms)
                    lines.append(line)
            else:
                if len(lines) > 1:
                    units = [(block, "\n".join(lines))]
                whole.update(block)
                prose += lines
                block, lines = Counter(), []
            for unit, words in units:
                if not templates.telling.isdisjoint(unit):
                    name, cosine = templates.best(unit, HEADER, lambda n, unit=unit: agrees(n, unit))
                    if name and cosine >= HEADER and not _DENIES(words.lower()):
                        every.add(name)
                        if (-cosine, name) < (-score, header or "~"):
                            header, score = name, cosine
        stated = spdx(text or "")
        if stated:
            header, score = stated, 1.0
            every |= {p for p in re.split(r"[()\s]+", stated) if p and p not in ("AND", "OR", "WITH")}
        file, likeness = licences.best(whole, prose)
        if not file and not templates.telling.isdisjoint(whole):
            file, likeness = templates.best(whole, FILE, lambda n, whole=whole: agrees(n, whole))
            if file and _DENIES(text.lower()):
                file, likeness = None, 0.0
        out.append((header, score, file, likeness, sorted(every)))
    return out


def scan(docs: DataFrame, path_col: str, text_col: str = "text", templates: dict[str, list[str]] | None = None, texts: dict[str, str] | None = None, keep_text: bool = True) -> tuple[DataFrame, list[str]]:
    """Append licence, cosine, origin (file, header, inherited, none), directory (from which it is inherited) and stated (all
    licences of the document's own header units and SPDX expression, in order of name; an empty list without any).

    path_col has paths separated by "/"; a document lies in the directory that its path names but for the last part, a
    relative path without "/" in ".", which is above all relative directories as "" is above the absolute ones.
    A directory's licence is that of most of its licence files, of equals the first in order of name; a licence file
    speaks for itself. Null texts have no licence of their own; null paths inherit nothing. Repeated rows each have
    their result and each count as a licence file. Other columns may have any name. templates are notices, texts whole
    licences; those of this module by default, own templates without texts have none. The annotated rows are written
    once to the shared folder, without the text if keep_text is off. Returns the table and the five columns' names.
    """
    names = fresh_names(docs, ["licence", "cosine", "origin", "directory", "stated"])
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "licences")
    chosen = spark.sparkContext.broadcast((templates or TEMPLATES, texts if texts is not None else {} if templates else licence_texts()))

    def make():
        own, whole = Templates(chosen.value[0]), LicenceTexts(chosen.value[1])

        def rows(texts: list[str | None], _: pa.RecordBatch) -> list[pa.Array]:
            found = own_licences(texts, own, whole)
            return [pa.array([x[0] for x in found], pa.string()), pa.array(np.array([x[1] for x in found], float)), pa.array([x[2] for x in found], pa.string()), pa.array(np.array([x[3] for x in found], float)), pa.array([x[4] for x in found], pa.list_(pa.string()))]

        return rows

    # the table's own columns travel in one, so that none can clash
    columns = [c for c in docs.columns if keep_text or c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col], F.lit(0).alias("_")).alias("row")
    place = F.when(F.contains(F.col(path_col), F.lit("/")), F.regexp_extract(path_col, r"(?s)^(.*)/[^/]*$", 1)).when(F.col(path_col).isNotNull(), ".").alias("dir")
    fields = [("header", "string"), ("header_cosine", "double"), ("file", "string"), ("file_cosine", "double"), ("stated", "array<string>")]
    found = annotate(docs.select(row, place, F.xxhash64(path_col).alias("salt"), F.col(text_col).alias("text")), "text", fields, make)
    found = scratch.write(found if keep_text else found.drop("text"), "found")

    votes = found.where(F.col("file").isNotNull() & F.col("dir").isNotNull()).groupBy("dir", "file").agg(F.count("*").alias("n"))
    holders = votes.groupBy(F.col("dir").alias("holder")).agg(F.min_by("file", F.struct(-F.col("n"), "file")).alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("holder")))
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit(".").alias("holder")))
    above = F.when(F.startswith(F.col("dir"), F.lit("/")) | (F.col("dir") == "") | (F.col("dir") == "."), above).otherwise(F.concat(root, above))
    dirs = found.select("dir").where(F.col("dir").isNotNull()).distinct()
    near = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.*").join(holders, "holder")
    near = near.groupBy("dir").agg(F.max_by(F.struct("holder", "given"), "depth").alias("near"))
    near = scratch.write(near, "near")
    if near.count() <= BROADCAST_DIRECTORIES:
        out = found.join(F.broadcast(near), "dir", "left")
    else:  # a directory may hold a third of all rows
        salted = near.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = found.withColumn("salt", F.pmod("salt", F.lit(SALTS))).join(salted, ["dir", "salt"], "left")
    licence = F.coalesce("file", "header", "near.given")
    origin = F.when(F.col("file").isNotNull(), "file").when(F.col("header").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    cosine = F.when(F.col("file").isNotNull(), F.col("file_cosine")).when(F.col("header").isNotNull(), F.col("header_cosine")).otherwise(0.0)
    directory = F.when(F.col("file").isNull() & F.col("header").isNull(), F.col("near.holder"))
    values = [licence, cosine, origin, directory, F.col("stated")]
    own = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns]
    return out.select(*own, *(v.alias(n) for v, n in zip(values, names, strict=True))), names


def report(docs: DataFrame) -> DataFrame:
    """doc_id, path, licence, cosine, origin, directory and stated of every document; its path is source/language/document."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string")).alias("path")
    out, names = scan(docs.select("doc_id", "text", path), "path", keep_text=False)
    return out.select("doc_id", "path", *names)
