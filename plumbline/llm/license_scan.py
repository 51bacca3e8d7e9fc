"""License scans by a positional index of rare words.

The index has, for each paragraph of the licence texts, where its words of the highest IDF stand: as many that an
alignment with enough of the paragraph's words in place must show SEEN of them. Of a file, the words that the index holds
are looked up; their postings, moved back by where the words stand, are sorted, and a (paragraph, relative position) that
comes up SEEN times is where the postings intersect. It counts if enough of the paragraph's words stand there and a
mandatory key phrase stands whole. All in column expressions, row by row: nothing is shuffled, and the work is in
proportion to a file's words and what they propose, but for the sort.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import BASE, TEMPLATES, Template

__all__ = ["BASE", "TEMPLATES", "Template", "license_scan"]

#: Rare words that an alignment must show.
SEEN = 2
#: A posting is a number: its paragraph's, times STRIDE, and a relative position, moved up so that it is positive.
STRIDE, UP = 1 << 40, 1 << 20
#: What a word is, in a raw text and in one whose A-Z are lower-cased.
_RAW_WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def need(words: int, enough: float) -> int:
    """Words in place that make a share of ``enough``."""
    return next(k for k in range(words + 1) if k / words >= enough)


def index(templates: tuple[Template, ...], enough: float) -> dict[str, list[int]]:
    """Postings by word: t * STRIDE + UP - place, for the rarest places of each template.

    An alignment may miss n - need(n) words, so of n - need(n) + SEEN places at least SEEN are in place."""
    own = [t.words.split() for t in templates]
    holders: dict[str, int] = defaultdict(int)
    for words in own:
        for w in set(words):
            holders[w] += 1
    out: dict[str, list[int]] = defaultdict(list)
    for t, words in enumerate(own):
        least = need(len(words), enough)
        if least < SEEN:
            raise ValueError(f"a template needs more words: {templates[t].words}")
        idf = [math.log(len(own) / holders[w]) for w in words]
        rarest = sorted(range(len(words)), key=lambda k: (-idf[k], k))
        for at in rarest[: len(words) - least + SEEN]:
            out[words[at]].append(t * STRIDE + UP - at)
    return dict(out)


def _looked_up(postings: dict[str, list[int]]):
    """A function from a word of the index to its postings: words are spread over small maps by a checksum, as a map is
    searched from end to end."""
    size = 1 << max(0, (len(postings) - 1).bit_length())
    slots: list[list[Column]] = [[] for _ in range(size)]
    for w, places in postings.items():
        slots[zlib.crc32(w.encode()) % size] += [F.lit(w), F.array(*(F.lit(p).cast("long") for p in places))]
    none = F.expr("cast(map() as map<string, array<bigint>>)")
    table = F.array(*(F.create_map(*s) if s else none for s in slots))
    return lambda w: F.element_at(F.get(table, F.pmod(F.crc32(w), F.lit(size)).cast("int")), w)


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _in_place(words: Column, own: Column, at: Column) -> Column:
    """How many of the words ``own`` stand one after another from ``at`` on."""
    return F.size(F.filter(own, lambda w, k: F.get(words, (at + k).cast("int")).eqNullSafe(w)))


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase among the words; other words pass with one comparison."""
    own = phrase.split()
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == own[0], i)), lambda i: i.isNotNull())
    return F.filter(starts, lambda i: _in_place(words, _texts(own), i) == len(own))


def _may_hold(text: Column, phrases: list[str]) -> Column:
    """False only for texts that hold none of the phrases: they lack one word of each, or, where all of its words are
    short, the phrase as a pattern. Nothing is counted without a whole phrase, so other texts need not be cut up."""
    open_ = {p: {w for w in p.split() if len(w) >= 6} for p in phrases}
    short = sorted(p for p, words in open_.items() if not words)
    open_ = {p: words for p, words in open_.items() if words}
    probes = []
    while open_:
        probe = max(sorted(set().union(*open_.values())), key=lambda w: (sum(w in x for x in open_.values()), len(w)))
        probes.append(probe)
        open_ = {p: words for p, words in open_.items() if probe not in words}
    gap = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    lowered = F.lower(text)
    out = [lowered.contains(w) for w in probes] + [F.rlike(text, F.lit("(?i)" + gap.join(p.split()))) for p in short]
    return reduce(lambda a, b: a | b, out)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, enough: float = 0.75) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters, digits and everything beyond ASCII, A-Z lower-cased. n_base counts the places of base
    phrases; first_word and last_word are their smallest and largest starts, from 0, else null. labels are the base
    labels and those of templates of whose words the share ``enough`` stand in place with a key phrase among them; both
    distinct, sorted, comma-joined. score: the best such share; 0.5 with base labels alone, else 0. No such alignment is
    missed: the index proposes all of them. Null counts as empty; repeated rows are scanned row by row; other columns are
    ignored; an empty table gives an empty result; a text and its words have to fit a row.
    """
    postings = index(templates, enough)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = _may_hold(text, sorted({*(p for p, _ in BASE), *(p for t in templates for p in t.phrases)}))
    words = F.when(seen, F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_RAW_WORD), F.lit(0))).otherwise(_texts([]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(_RAW_WORD)).cast("long").alias("n_words"), words.alias("words"))

    at = _looked_up(postings)
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*postings), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    proposed = F.flatten(F.transform(hits, lambda h: F.transform(at(h["w"]), lambda p: p + h["i"])))
    rows = rows.withColumn("base", F.array(*(_places(F.col("words"), p) for p, _ in BASE))).withColumn("proposed", F.sort_array(proposed))
    met = lambda x, i: (F.get("proposed", i + SEEN - 1) == x) & ~F.coalesce(F.get("proposed", i - 1) == x, F.lit(False))
    rows = rows.withColumn("met", F.filter("proposed", met))

    listed = F.array(*(_texts(t.words.split()) for t in templates))
    keys = F.array(*(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in _phrase_places(t))) for t in templates))
    names = _texts([t.label for t in templates])
    aligned = F.transform("met", lambda x: F.struct((F.shiftright(x, 40)).cast("int").alias("t"), (x.bitwiseAND(F.lit(STRIDE - 1)) - UP).cast("int").alias("off")))
    share = lambda p: _in_place(F.col("words"), F.get(listed, p["t"]), p["off"]) / F.size(F.get(listed, p["t"]))
    scored = F.transform(aligned, lambda p: F.struct(p["t"].alias("t"), p["off"].alias("off"), share(p).alias("share")))
    whole = lambda p: F.exists(F.get(keys, p["t"]), lambda k: _in_place(F.col("words"), F.slice(F.get(listed, p["t"]), k["a"] + 1, k["n"]), p["off"] + k["a"]) == k["n"])
    rows = rows.withColumn("found", F.filter(F.filter(scored, lambda p: p["share"] >= enough), whole))
    places = F.flatten("base")
    base = F.filter(F.array(*(F.when(F.size(F.get("base", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE))), lambda x: x.isNotNull())
    labels = F.concat(base, F.transform("found", lambda p: F.get(names, p["t"])))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.array_max(F.transform("found", lambda p: p["share"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(labels).alias("labels"),
        F.coalesce(best, F.when(F.size(places) > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )


def _phrase_places(template: Template) -> list[tuple[int, int]]:
    """(first place, words) of each of the template's phrases in its words."""
    own = template.words.split()
    out = []
    for phrase in template.phrases:
        n = len(phrase.split())
        out.append((next(i for i in range(len(own)) if own[i : i + n] == phrase.split()), n))
    return out
