"""License scans by a positional index of rare words.

A template is the word sequence of a licence notice. Its words weigh by their rarity in the corpus
(inverse document frequency over all documents), and it matches a text where enough of its weight
stands at the right relative places:

1. One pass counts the documents of every licence word (the words of all templates, a few hundred).
2. Each template's rarest words, as many as are needed to weigh more than a match may miss, are its
   anchors: a match holds at least one of them. A file's words are looked up among the anchors
   first, so the common words of a licence ("the", "software") cost nothing elsewhere.
3. A posting is (template, place in it). A hit at text word p proposes the relative position p -
   place. Around the proposed positions the postings of all the template's words are intersected: a
   band of relative positions d to d + slack collects the places that are met, each once. The slack
   admits words put in or left out.
4. A band that weighs enough must hold the template's mandatory key phrases, word by word.

Phrases that stand for a label by themselves are found the same way, as consecutive words.
Every text is scanned whole and alone; only the counts of step 1 are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.llm.shared import columns
from staylink.llm.words import Words, same_bytes, slices

#: Word bytes of the contract: digits, letters, and everything beyond ASCII.
SEPARATORS = np.ones(256, bool)
SEPARATORS[48:58] = SEPARATORS[65:91] = SEPARATORS[97:123] = SEPARATORS[128:] = False

#: Phrases that stand for a label by themselves.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label, notice, key phrases that must stand in a match.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license", "in compliance with the license")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions")),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "above copyright notice")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
)

#: Percent of a template's weight that a match holds, and words put in or left out, one for each EVERY words of it.
PERCENT, EVERY = 75, 5
#: Cells (place by relative position) that one step of the intersection compares.
_STEP = 1 << 20


def slack(words: int) -> int:
    return max(1, words // EVERY)


@dataclass
class Index:
    """Vocabulary, weights, anchors and postings of the templates and phrases."""

    templates: tuple = TEMPLATES
    phrases: tuple = PHRASES
    percent: int = PERCENT
    weights: dict[str, int] | None = None

    @cached_property
    def vocabulary(self) -> list[str]:
        texts = [t for _, t, _ in self.templates] + [k for *_, ks in self.templates for k in ks] + [p for p, _ in self.phrases]
        return sorted({w for t in texts for w in t.split()})

    @cached_property
    def number(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.vocabulary)}

    def sequence(self, text: str) -> np.ndarray:
        return np.array([self.number[w] for w in text.split()], np.int32)

    @cached_property
    def _keys(self):
        words = Words(pa.array([" ".join(self.vocabulary)]), SEPARATORS)
        h = words.hashes()
        order = np.argsort(h)
        return words, h[order], order

    def numbers(self, words: Words) -> np.ndarray:
        """The vocabulary number of every word, -1 for others; equal hashes are compared by bytes."""
        own, keys, order = self._keys
        out = np.full(len(words.starts), -1, np.int32)
        h = words.hashes()
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == h)
        mine = order[at[hit]]
        size = own.ends[mine] - own.starts[mine]
        equal = words.ends[hit] - words.starts[hit] == size
        hit, mine, size = hit[equal], mine[equal], size[equal]
        equal = same_bytes(words.raw, words.starts[hit], own.raw, own.starts[mine], size)
        out[hit[equal]] = mine[equal]
        return out

    @cached_property
    def plans(self) -> list[tuple[np.ndarray, np.ndarray, int, list[int], list[np.ndarray]]]:
        """(words, weight of each, all weight, anchor places, key phrases) of every template."""
        out = []
        for _, text, keys in self.templates:
            weight = np.array([(self.weights or {}).get(w, 1) for w in text.split()], np.int64)
            whole, missed, anchors = int(weight.sum()), 0, []
            for place in np.argsort(-weight, kind="stable").tolist():  # rarest first
                anchors.append(place)
                missed += int(weight[place])
                if 100 * (whole - missed) < self.percent * whole:  # without these a match is impossible
                    break
            out.append((self.sequence(text), weight, whole, anchors, [self.sequence(k) for k in keys]))
        return out


def consecutive(number: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """The words at which the phrase stands, word by word inside one text."""
    at = np.flatnonzero(number == phrase[0])
    at = at[at + len(phrase) <= len(number)]
    for j in range(1, len(phrase)):
        at = at[(number[at + j] == phrase[j]) & (doc[at + j] == doc[at])]
    return at


def matches(index: Index, words: Words, number: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(text, template, relative position, share of weight) of the best band of every template that matches a text;
    the earliest of equally good ones."""
    doc = words.doc
    known = np.flatnonzero(number >= 0)
    by_word = known[np.argsort(number[known], kind="stable")]
    begin = np.searchsorted(number[by_word], np.arange(len(index.vocabulary) + 1))
    out = []
    for t, (sequence, weight, whole, anchors, keys) in enumerate(index.plans):
        m, wide = len(sequence), slack(len(sequence))
        places = [by_word[begin[w] : begin[w + 1]] for w in sequence[anchors]]
        d = np.concatenate([p - a for p, a in zip(places, anchors, strict=True)])
        if not len(d):
            continue
        owner = doc[np.concatenate(places)]
        # every band that holds an anchor's hit: text and relative position, each once
        pairs = np.unique(np.stack([np.repeat(owner, wide + 1), (d[:, None] - np.arange(wide + 1)).ravel()], 1), axis=0)
        where = None
        for lo in range(0, len(pairs), max(1, _STEP // m)):
            owner, d = pairs[lo : lo + max(1, _STEP // m)].T
            first, last = words.first[owner][:, None], words.first[owner + 1][:, None]
            met = np.zeros((len(d), m), bool)
            for e in range(wide + 1):
                at = (d + e)[:, None] + np.arange(m)
                met |= (at >= first) & (at < last) & (number[np.clip(at, 0, len(number) - 1)] == sequence)
                if e == 0:
                    begins = met.any(1)
            got = met @ weight
            good = np.flatnonzero(begins & (100 * got >= index.percent * whole))
            if not len(good):
                continue
            if where is None:
                where = [consecutive(number, doc, k) for k in keys]
            for k, found in zip(keys, where, strict=True):
                low = np.maximum(d[good], first[good, 0])
                high = np.minimum(d[good] + m + wide, last[good, 0]) - len(k)
                good = good[np.searchsorted(found, high, "right") > np.searchsorted(found, low)]
            out += [(int(owner[g]), t, int(d[g] - first[g, 0]), float(got[g]) / whole) for g in good.tolist()]
    best: dict[tuple[int, int], tuple[int, float]] = {}
    for text, t, d, share in sorted(out):
        if (text, t) not in best or share > best[text, t][1]:
            best[text, t] = (d, share)
    return [(text, t, d, share) for (text, t), (d, share) in sorted(best.items())]


def frequencies(docs: DataFrame, index: Index) -> dict[str, int]:
    """The weight of every licence word from the share of all documents that hold it: a table of the
    vocabulary's size, whatever the corpus."""
    size = len(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(size, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), SEPARATORS, lower=True)
                number = index.numbers(words)
                known = np.flatnonzero(number >= 0)
                held = np.unique(words.doc[known] * size + number[known])
                total += np.bincount(held % size, minlength=size)
                texts += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(np.append(total, texts))], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = {r.word: r.n for r in rows}
    texts = count.get(size, 0)
    return {w: 1 + round(1000 * math.log((texts + 1) / (count.get(i, 0) + 1))) for i, w in enumerate(index.vocabulary)}


SCHEMA = """doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>,
matches array<struct<label:string, template:int, word:int, share:double>>"""


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: n_words; the places of the phrases (n_base, the first and last word at which one
    starts, else null; base_labels, distinct and sorted) and the templates that match (label, number of
    the template, word at which the band begins, which is negative if the text begins inside the
    notice, and share of the template's weight).

    Texts are lower-cased (A-Z); words are runs of digits, letters and characters beyond ASCII.
    Null and empty texts have no words; equal rows are scanned alike; rows without an id too. Other
    columns, whatever their names, are never read. A word's weight depends on how many of the given
    documents hold it, repeated rows included.
    """
    own = columns(docs, doc_id=id_col, text=text_col)
    index = Index(templates, phrases, percent)
    index = Index(templates, phrases, percent, frequencies(own, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _scanned(index, part)

    return own.mapInArrow(run, SCHEMA)


def _scanned(index: Index, part: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(part.column("text"), SEPARATORS, lower=True)
    number, doc = index.numbers(words), words.doc
    n = part.num_rows
    count = np.zeros(n, np.int64)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    labels: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in index.phrases:
        at = consecutive(number, doc, index.sequence(phrase))
        texts = doc[at]
        count += np.bincount(texts, minlength=n)
        place = at - words.first[texts]
        np.minimum.at(low, texts, place)
        np.maximum.at(high, texts, place)
        for i in np.unique(texts).tolist():
            labels[i].add(label)
    found: list[list[dict]] = [[] for _ in range(n)]
    for text, t, d, share in matches(index, words, number):
        found[text].append({"label": index.templates[t][0], "template": t, "word": d, "share": share})
    none = count == 0
    kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("word", pa.int32()), ("share", pa.float64())]))
    out = [part.column("doc_id").cast(pa.int64()), pa.array(words.counts.astype(np.int64)), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none)]
    out += [pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.array(found, kind)]
    return pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches"])


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = F.array_join(F.array_sort(F.array_union("base_labels", F.transform("matches", lambda m: m["label"]))), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def _sql() -> str:
    def rows(items):
        return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in item) + ")" for item in items)

    places = rows([(t, label, len(text.split()), slack(len(text.split())), i, w) for t, (label, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())])
    keys = rows([(t, k) for t, (*_, ks) in enumerate(TEMPLATES) for k in ks])
    base = rows([(p, label, len(p.split())) for p, label in PHRASES])
    return rf"""
with place(t, label, m, s, i, word) as (values {places}), key(t, k) as (values {keys}), phrase(p, label, m) as (values {base}),
doc as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), word as (
  select doc_id, unnest(w) word, unnest(range(0, len(w))) p from doc where len(w) > 0
), starts as (
  select doc_id, p.label, unnest(list_filter(range(0, len(w)), lambda x: array_to_string(w[x + 1:x + p.m], ' ') = p.p)) p
  from doc, phrase p where contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p.p || ' ')
), based as (
  select doc_id, count(*) n_base, min(p) first_word, max(p) last_word, string_agg(distinct label, ',' order by label) base_labels from starts group by doc_id
), weight as (
  select word, 1 + cast(round(1000 * ln(((select count(*) from doc) + 1) / (count(distinct doc_id) + 1))) as bigint) wt
  from (select distinct word from place) left join word using (word) group by word
), template as (
  select t, label, m, s, sum(wt) whole from place join weight using (word) group by all
), hit as materialized (
  select doc_id, t, i, p - i d, wt from word join place using (word) join weight using (word)
), likely as (
  select doc_id, t from (select distinct doc_id, t, i, wt from hit) join template using (t) group by doc_id, t, whole having 100 * sum(wt) >= {PERCENT} * whole
), near as materialized (
  select hit.* from hit join likely using (doc_id, t)
), band as (
  select doc_id, t, d, m, s, whole, label, sum(wt) got from (
    select distinct a.doc_id, a.t, a.d, b.i, b.wt, m, s, whole, label from (select distinct doc_id, t, d from near) a
    join template using (t) join near b on b.doc_id = a.doc_id and b.t = a.t and b.d between a.d and a.d + s
  ) group by all having 100 * sum(wt) >= {PERCENT} * whole
), good as (
  select band.* from band join doc using (doc_id)
  where not exists (from key where key.t = band.t and not contains(' ' || array_to_string(w[greatest(d, 0) + 1:d + m + s], ' ') || ' ', ' ' || key.k || ' '))
), matched as (
  select doc_id, max(got / whole) score from good group by doc_id
), label as (
  select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from good union all select doc_id, label from starts) group by doc_id
)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
  cast(case when n_base > 0 then 1 else coalesce(score, 0) end as double) score
from doc left join based using (doc_id) left join matched using (doc_id) left join label using (doc_id)
"""


SQL = _sql()
