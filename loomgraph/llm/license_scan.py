"""License scans: base phrases by place, and templates by an exact set-similarity join.

A block is a run of words of a text, across line ends, no longer than the
template's own words and a quarter more. It matches a template when it holds at
least `threshold` of the template's distinct words, all that tell the license
from its like (`must`) and none that tell the like from it (`never`). The join
finds every such block:

1. Template words are put in the order of their frequency over all documents,
   rarest first. Of a template with n words the first n - ceil(threshold * n) + 1
   are its prefix: a block that reaches the threshold holds one of them.
2. Each place of a prefix word in a text meets its templates. By length, the
   words within a block's reach of it must hold enough of the template's; by
   position, enough of those at or after the prefix word in the order, since a
   block is found by the rarest of its shared words.
3. The blocks around the place are verified word by word.

Texts are cut into words once. What is kept of a text beside its counts is the
list of template words in it, and its words only where it holds enough of some
template's anywhere. Texts are never shuffled. The templates are a fixed list,
so what is broadcast doesn't grow with the input. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD, SPREAD = 0.8, 1.25


@dataclass(frozen=True)
class Template:
    """A notice, the words without which it isn't this license, and those with which it is another."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()

    @property
    def sequence(self) -> list[str]:
        return [w for w in re.split(NOT_WORD, self.text.translate(str.maketrans(UPPER, LOWER))) if w]

    @property
    def words(self) -> list[str]:
        return sorted(set(self.sequence))

    @property
    def reach(self) -> int:
        """The most words in a block."""
        return -int(-SPREAD * len(self.sequence) // 1)


#: The templates of the method.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache",)),
    Template("mit", "released under the mit license", ("mit", "license")),
    Template("mit", "licensed under the mit license", ("mit", "license")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu", "3"), ("lesser", "affero")),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu",), ("lesser", "affero")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc", "by", "sa")),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0", ("waived",)),
    Template("all-rights-reserved", "all rights reserved"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",)),
)


def needed(n: int, threshold: float) -> int:
    """The least overlap that a template of n words asks for."""
    return max(1, -int(-(round(threshold * 1e6) * n) // 1_000_000))


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    """All template words, and those that exclude."""
    return sorted({w for t in templates for w in (*t.words, *t.never)})


def lowered(column: str) -> Column:
    """A-Z in lower case. lower() is faster and the same where no other character has a lower case of ASCII letters, as two have."""
    c = F.coalesce(F.col(column), F.lit(""))
    odd = F.contains(c, F.lit("\u212a")) | F.contains(c, F.lit("\u0130"))
    return F.when(odd, F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def words_of(column: str) -> str:
    return f"array_remove(split({column}, '{_quoted(NOT_WORD)}'), '')"


def _place(phrase: str) -> str:
    """SQL: the words' places at which the phrase starts."""
    first, *rest = phrase.split()
    more = "".join(f" and get(_words, i + {k}) = '{w}'" for k, w in enumerate(rest, 1))
    return f"if(contains(_joined, ' {phrase} '), filter(transform(_words, (w, i) -> if(w = '{first}'{more}, i, null)), i -> i is not null), cast(array() as array<int>))"


def tokenised(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, path: str = "doc_id") -> DataFrame:
    """A row for each row of docs: _row (its number), doc_id, n_words, the places of the base phrases, _in (the template words in the text) and _kept: its words, where they hold enough of some template's, else null."""
    some = vocabulary(templates)
    own = docs.select(F.col(path).alias("doc_id"), lowered("text").alias("_text")).withColumn("_words", F.expr(words_of("_text")))
    own = own.withColumn("_in", F.array_intersect("_words", F.array(*map(F.lit, some)))).withColumn("_joined", F.expr("concat(' ', array_join(_words, ' '), ' ')"))
    enough = " or ".join(f"size(array_intersect(_in, array({', '.join(map(repr, t.words))}))) >= {needed(len(t.words), threshold)}" for t in templates)
    return own.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.expr("cast(size(_words) as bigint)").alias("n_words"),
        *(F.expr(_place(p)).alias(f"_p{i}") for i, p in enumerate(PHRASES)),
        "_in",
        F.expr(f"if({enough}, _words, null)").alias("_kept"),
    )


def frequencies(tokens: DataFrame) -> dict[str, int]:
    """In how many documents each template word stands: at most as many rows as the templates have words come to the driver."""
    return {r.w: r["count"] for r in tokens.select(F.explode("_in").alias("w")).groupBy("w").count().collect()}


def ranked(templates: tuple[Template, ...], frequency: dict[str, int]) -> dict[str, int]:
    """Each template word's place in the order, rarest first."""
    order = sorted(vocabulary(templates), key=lambda w: (frequency.get(w, 0), w))
    return {w: i for i, w in enumerate(order)}


def postings(templates: tuple[Template, ...], rank: dict[str, int], threshold: float) -> list[dict]:
    """A row for each prefix word of each template: token, template (number), label, words, must and never by rank, least overlap, reach, and the word's place in the template's order."""
    out = []
    for k, t in enumerate(templates):
        words = sorted(rank[w] for w in t.words)
        least = needed(len(words), threshold)
        for place, token in enumerate(words[: len(words) - least + 1]):
            out.append({"token": token, "template": k, "label": t.label, "t_words": words, "must": [rank[w] for w in t.must], "never": [rank[w] for w in t.never], "least": least, "reach": t.reach, "place": place})
    return out


#: SQL: the template's words within a block's reach of a prefix word at place p.
_NEAR = "filter(_hits, h -> h.i > p - reach and h.i < p + reach and (array_contains(t_words, h.r) or array_contains(never, h.r)))"
#: SQL: of the blocks that hold place p and start at a template word, the greatest (overlap, -start); null if none counts.
_BEST = """
array_max(filter(transform(filter(_near, a -> a.i <= p and array_contains(t_words, a.r)), a -> element_at(transform(
    array(array_distinct(transform(filter(_near, b -> b.i >= a.i and b.i < a.i + reach), b -> b.r))),
    s -> if(size(array_except(must, s)) = 0 and not arrays_overlap(never, s), named_struct('overlap', size(array_intersect(s, t_words)), 'start', -a.i), null)), 1)),
  x -> x is not null))"""


def candidates(tokens: DataFrame, templates: tuple[Template, ...], threshold: float, rank: dict[str, int]) -> DataFrame:
    """Places of prefix words with their template that pass the length and the positional filter; _near holds the template's words around each."""
    order = F.array(*(F.lit(w) for w in sorted(rank, key=rank.get)))
    hits = F.filter(F.transform("_kept", lambda w, i: F.struct(i.alias("i"), (F.array_position(order, w) - 1).cast("int").alias("r"))), lambda h: h.r >= 0)
    literal = lambda x: F.array(*map(F.lit, x)).cast("array<int>") if isinstance(x, list) else F.lit(x)
    rows = [F.struct(*(literal(x).alias(k) for k, x in row.items())) for row in postings(templates, rank, threshold)]
    fixed = tokens.sparkSession.range(1).select(F.inline(F.array(*rows)))
    found = tokens.filter("_kept is not null").select("_row", "doc_id", hits.alias("_hits"))
    prefix = sorted({x["token"] for x in postings(templates, rank, threshold)})
    at = found.select("_row", "doc_id", "_hits", F.explode(F.filter("_hits", lambda h: F.array_contains(F.array(*map(F.lit, prefix)), h.r))).alias("_at"))
    met = at.join(F.broadcast(fixed), F.col("_at.r") == F.col("token")).withColumn("p", F.col("_at.i")).withColumn("_near", F.expr(_NEAR))
    distinct = "size(array_intersect(array_distinct(transform(_near, h -> h.r)), {}))"
    return met.filter(f"{distinct.format('t_words')} >= least").filter(f"{distinct.format('slice(t_words, place + 1, size(t_words))')} >= least")


def matches(tokens: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, frequency: dict[str, int] | None = None) -> DataFrame:
    """_row, doc_id, label, overlap, containment and start (in words) of the best block of each template that a text matches; of equals the first. tokens: of `tokenised`."""
    rank = ranked(templates, frequency if frequency is not None else frequencies(tokens))
    best = candidates(tokens, templates, threshold, rank).withColumn("_best", F.expr(_BEST)).filter("_best.overlap >= least")
    each = best.groupBy("_row", "doc_id", "template", "label").agg(F.max("_best").alias("_best"), F.first(F.size("t_words")).alias("_n"))
    return each.select("_row", "doc_id", "label", F.col("_best.overlap").alias("overlap"), (F.col("_best.overlap") / F.col("_n")).alias("containment"), (-F.col("_best.start")).alias("start"))


def digest(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The query's columns, a row for each row of docs, repeated ones too; other columns are not read.

    A null or empty text has no words. labels holds the base labels and those
    of matching templates; score is 1 with a base phrase, else the largest
    containment that reached the threshold, else 0.
    """
    tokens = staged(tokenised(docs, threshold=threshold), "tokens")
    p = [f"_p{i}" for i in range(len(PHRASES))]
    every = F.concat(*p)
    own = tokens.select(
        "_row",
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*(F.when(F.size(x) > 0, F.lit(label)) for x, label in zip(p, PHRASES.values(), strict=True))))).alias("_base"),
        F.col("_kept").isNotNull().alias("_likely"),
    )
    found = matches(tokens, threshold=threshold).groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    plain = own.filter("not _likely").select("*", F.lit(None).cast("array<string>").alias("_more"), F.lit(None).cast("double").alias("_best"))
    rows = plain.unionByName(own.filter("_likely").join(found, "_row", "left"))
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
