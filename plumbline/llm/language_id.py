"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language (byte trigrams), the language its markup declares, its address's suffix and a
prior for its host are multiplied. Host priors come from grouped counts: a host's are smoothed by its domain's, these by
those of all rows. A text that none of the languages explains as well as it should its own is in none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import grouped, small_batches, streamed, written

#: Hash places for trigrams; bytes handled at a time for one language.
PLACES, CHUNK = 1 << 15, 2_000_000
#: Deviations by which a text may fall below a language's floor.
ALLOWANCE = 2.0
#: The least logarithm of a share that counts against a floor, so that a key or an address in a short text doesn't decide.
LEAST_SHARE = -np.log(PLACES) - 2
#: Characters beyond ASCII that are no letters, and marks that stand on none.
NO_LETTERS = r"[^\p{ASCII}\p{L}\p{M}]+|(?<![\p{L}\p{M}])\p{M}+"
#: Languages that a model can have: 128 KB each are sent to every worker. More labels are an error.
MOST_LANGUAGES = 1000
#: Languages whose counts a task holds at once.
HELD = 128
#: Hosts, and numbers in their priors, up to which these are broadcast.
MOST_HOSTS, MOST_NUMBERS = 100_000, 6_400_000
# Address suffixes of countries and the language most of their pages are in.
SUFFIXES = {"ar": "es", "at": "de", "au": "en", "br": "pt", "ca": "en", "ch": "de", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "mx": "es", "nl": "nl", "nz": "en", "pt": "pt", "uk": "en", "us": "en"}


def _folded() -> np.ndarray:
    """Letters lower-cased, every other ASCII byte a blank; bytes beyond ASCII stay."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


_FOLD = _folded()


def _trigrams(text: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, codes) of all trigrams with a letter in the middle, some bytes at a time."""
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    for start in range(0, len(raw), width):
        piece = _FOLD[raw[max(0, start - 1) : start + width + 1]].astype(np.uint32)
        first = max(0, start - 1)
        if len(piece) < 3:
            continue
        code = (piece[:-2] << np.uint32(16)) | (piece[1:-1] << np.uint32(8)) | piece[2:]
        middle = np.arange(first + 1, first + len(piece) - 1)
        row = np.searchsorted(offsets, middle, side="right") - 1
        inside = (piece[1:-1] != 32) & (offsets[row] < middle) & (middle + 1 < offsets[row + 1])
        yield row[inside], code[inside]


def _place(code: np.ndarray) -> np.ndarray:
    return code * np.uint32(2654435761) >> np.uint32(17)


def _letters(text: Column) -> Column:
    """Text whose characters that are no letters can't pass for some: ASCII ones are folded later, others are blanks."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(text, NO_LETTERS, " "))


def _sparse(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    places = [np.flatnonzero(c) for c in counts.values()]
    numbers = [c[at].astype("<i8").tobytes() for c, at in zip(counts.values(), places)]
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([x.astype("<u2").tobytes() for x in places], pa.binary()), pa.array(numbers, pa.binary())], names=["language", "places", "counts"])


def _tallied(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """Per language the counts of places, then those of the first, second and third bytes of trigrams: what isn't zero."""
    counts: dict[int, np.ndarray] = {}
    number = {x: i for i, x in enumerate(languages)}
    for batch in batches:
        label = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
        order = np.argsort(label, kind="stable")
        label = label[order]
        for row, codes in _trigrams(batch.column(0).take(pa.array(order)), CHUNK // 4):
            own = label[row]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
            for start, end in zip(starts, [*starts[1:], len(own)]):
                if own[start] not in counts and len(counts) >= HELD:
                    yield _sparse(counts)
                    counts = {}
                mine, code = counts.setdefault(int(own[start]), np.zeros(PLACES + 3 * 256, np.int64)), codes[start:end]
                mine[:PLACES] += np.bincount(_place(code), minlength=PLACES)
                for k, shift in enumerate((16, 8, 0)):
                    at = PLACES + 256 * k
                    mine[at : at + 256] += np.bincount(code >> np.uint32(shift) & np.uint32(255), minlength=256)
    if counts:
        yield _sparse(counts)


def _added(table: pa.Table, smoothing: float) -> pa.Table:
    """One language's logarithms of shares, floor and deviation."""
    total = np.zeros(PLACES + 3 * 256, np.int64)
    for places, counts in zip(table.column("places"), table.column("counts")):
        total[np.frombuffer(places.as_py(), "<u2")] += np.frombuffer(counts.as_py(), "<i8")
    smooth = total[:PLACES] + smoothing
    floor, deviation = _floor(total, smoothing)
    weights = np.log(smooth / smooth.sum()).astype("<f4").tobytes()
    return pa.table({"language": table.column("language")[:1], "weights": pa.array([weights], pa.binary()), "floor": [floor], "deviation": [deviation]})


class Model:
    """Logarithms of trigram shares, a row for each language; the mean of them that a text in it has at least, and the
    deviation of a single one."""

    def __init__(self, languages: list[str], weights: np.ndarray, floors: np.ndarray, deviations: np.ndarray):
        self.languages, self.weights, self.floors, self.deviations = languages, weights, floors, deviations


def _floor(counts: np.ndarray, smoothing: float) -> tuple[float, float]:
    """From one language's counts: a mean halfway between that of its own text, each trigram judged by all the others,
    and that of its letters in random order, and the deviation of its own text's trigrams. Shares no higher than those
    of a uniform choice are no sign of a language, however few rows it was trained on."""
    own, bytes_ = counts[:PLACES].astype(np.float64), counts[PLACES:].reshape(3, 256)
    n = own.sum()
    if not n:
        return 0.0, 0.0
    rest = np.log((np.maximum(own - 1, 0) + smoothing) / (n - 1 + smoothing * PLACES))
    mean = float(own @ rest / n)
    deviation = float(np.sqrt(max(0.0, own @ rest**2 / n - mean**2)))
    used = [np.flatnonzero(b) for b in bytes_]
    a, b, c = (b[u] / n for b, u in zip(bytes_, used))
    x, y, z = (u.astype(np.uint32) for u in used)
    weights = np.log((own + smoothing) / (n + smoothing * PLACES))
    none = sum(float(share * (b[:, None] * c[None] * weights[_place(first << np.uint32(16) | y[:, None] << np.uint32(8) | z[None])]).sum()) for first, share in zip(x, a))
    return (mean + none) / 2, deviation


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Trigram shares of each label over all labelled rows, however rare the label; a task sends its counts that aren't
    zero. More than MOST_LANGUAGES labels are an error."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(_letters(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull())
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} different labels, which is more than a model can have")
    if not languages:
        return Model(["und"], np.zeros((1, PLACES), np.float32), np.zeros(1), np.zeros(1))
    counts = rows.mapInArrow(streamed(_tallied, languages), "language int, places binary, counts binary")
    shares = counts.groupBy("language").applyInArrow(grouped(_added, smoothing), "language int, weights binary, floor double, deviation double")
    weights, floors, deviations = np.full((len(languages), PLACES), -np.log(PLACES), np.float32), np.zeros(len(languages)), np.zeros(len(languages))
    for r in shares.collect():  # one row of PLACES floats for each language
        weights[r["language"]], floors[r["language"]], deviations[r["language"]] = np.frombuffer(r["weights"], "<f4"), r["floor"], r["deviation"]
    return Model(languages, weights, floors, deviations)


def _scored(
    batches: Iterator[pa.RecordBatch], weights, languages: list[str], floors: np.ndarray, deviations: np.ndarray, cap: float, declared_trust: float, suffix_trust: float
) -> Iterator[pa.RecordBatch]:
    """Logarithms of a row's evidence for each language; whether its text is in none and something known is declared;
    the number of the language, from 1, that its evidence is for."""
    table = weights.value
    size = table.shape[1]
    said = {x.lower(): i for i, x in enumerate(languages)} | {x: i for i, x in enumerate(languages)}
    ending = {k: languages.index(x) for k, x in SUFFIXES.items() if x in languages}
    names = ["row", "score", "n_trigrams", "strange", "heard", "best"]
    for batch in batches:
        score, n = np.zeros((batch.num_rows, size)), np.zeros(batch.num_rows, np.int64)
        held = np.zeros((batch.num_rows, size))
        for row, code in _trigrams(batch.column(1), max(5_000, CHUNK // size)):
            if len(row):
                at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                found = table[_place(code)]
                score[row[at]] += np.add.reduceat(found, at, axis=0, dtype=np.float64)
                held[row[at]] += np.add.reduceat(np.maximum(found, np.float32(LEAST_SHARE)), at, axis=0, dtype=np.float64)
                n[row[at]] += np.diff(np.r_[at, len(row)])
        some = np.maximum(n, 1)[:, None]
        least = np.maximum(floors - ALLOWANCE * deviations * np.sqrt((1 + some / cap) / some), -np.log(PLACES))
        strange = (n > 0) & (held / some < least).all(axis=1)
        score *= (1 / (1 + n / cap))[:, None]
        heard = np.zeros(batch.num_rows, bool)
        for column, known, trust in ((2, said, declared_trust), (3, ending, suffix_trust)):
            which = np.array([known.get(x, -1) for x in batch.column(column).to_pylist()], np.int64)
            at = np.flatnonzero(which >= 0)
            if len(at):
                chance = np.full((len(at), size), (1 - trust) / max(1, size - 1))
                chance[np.arange(len(at)), which[at]] = trust
                score[at] += np.log(chance)
            if known is said:
                heard[at] = True
        best = pa.array(score.argmax(axis=1) + 1, pa.int32(), mask=(n == 0) | strange)
        ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(score.ravel())), pa.array(n), pa.array(strange), pa.array(heard), best], names=names)


def _dense(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Lists of languages and numbers of rows as an array of a number for each language."""
    for batch in batches:
        own = np.zeros((batch.num_rows, size))
        for row, pairs in zip(own, batch.column(batch.num_columns - 1).to_pylist()):
            for x in pairs:
                row[x["best"] - 1] = x["n"]
        ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(own.ravel()))], names=[*batch.schema.names[:-1], "own"])


def _logs(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _sum(*arrays: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), arrays)


def identify(
    docs: DataFrame,
    model: Model,
    keep: list[str],
    text_col: str = "text",
    declared_col: str | None = None,
    suffix_col: str | None = None,
    host_col: str | None = None,
    domain_col: str | None = None,
    declared_trust: float = 0.9,
    suffix_trust: float = 0.7,
    weight: float = 20.0,
    evidence_cap: float = 200.0,
    least_confidence: float = 0.5,
) -> DataFrame:
    """Per row of docs: the columns ``keep``, language, confidence (its posterior), n_trigrams, rejected. A kept column that
    has one of these names is left out.

    n trigrams count as n / (1 + n / evidence_cap) independent ones, as neighbours depend on each other. ``weight``: rows
    that a host's domain, and a domain's whole, are worth in smoothing. A row is rejected if its text has no trigram with
    a letter in it (null, empty or blank ones, numbers, symbols) and nothing is declared, if its text is in none of the
    model's languages, or if its confidence is less than ``least_confidence``. A text is in none if for each language its
    mean likelihood is below the language's floor by more than chance in a text of its length, or below that of a uniform
    choice; its confidence is zero, language the nearest one, and it says nothing about its host. Declarations and suffixes that are null or unknown say nothing; null hosts are one host.
    Rows that repeat are judged row by row; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in keep if c not in ("language", "confidence", "n_trigrams", "rejected")]
    weights = spark.sparkContext.broadcast(np.ascontiguousarray(model.weights.T))  # PLACES times languages floats: 128 MB at most
    names, size = model.languages, len(model.languages)
    col = lambda c: F.lit(None).cast("string") if c is None else F.lower(F.col(c).cast("string"))
    host, domain = F.coalesce(col(host_col), F.lit("")), F.coalesce(col(domain_col), F.lit(""))
    letters = _letters(F.col(text_col).cast("string"))
    kept = F.struct(*keep) if keep else F.struct(F.lit(None).cast("string").alias("none"))
    row = F.struct(kept.alias("kept"), host.alias("host"), domain.alias("domain"))
    source = docs.select(row.alias("row"), letters.alias("text"), col(declared_col).alias("declared"), col(suffix_col).alias("suffix"))
    kind = f"row {source.schema['row'].dataType.simpleString()}, score array<double>, n_trigrams long, strange boolean, heard boolean, best int"
    judge = streamed(_scored, weights, names, model.floors, model.deviations, evidence_cap, declared_trust, suffix_trust)
    rows = written(source.mapInArrow(judge, kind).select("row.*", "score", "n_trigrams", "strange", "heard", "best"), "language-scores")

    top = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    counts = written(rows.groupBy("domain", "host", "best").agg(F.count(F.lit(1)).alias("n")), "language-hosts")
    total = np.ones(size)
    for r in counts.filter("best IS NOT NULL").groupBy("best").agg(F.sum("n").alias("n")).collect():  # a row for each language
        total[r["best"] - 1] += r["n"]
    general = total / total.sum()
    smooth = lambda own, prior: F.zip_with(own, prior, lambda c, p: (c + p * weight) / (F.aggregate(own, F.lit(0.0), lambda s, x: s + x) + weight))

    def dense(*by: str) -> DataFrame:
        found = counts.groupBy(*by, "best").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "n"))).alias("pairs"))
        return found.mapInArrow(streamed(_dense, size), ", ".join(f"{x} string" for x in by) + ", own array<double>")

    domains = dense("domain").select("domain", smooth(F.col("own"), _logs(general)).alias("of_domain"))
    priors = dense("domain", "host").join(domains, "domain").select("domain", "host", F.transform(smooth(F.col("own"), F.col("of_domain")), lambda x: F.log(x)).alias("prior"))
    if counts.select("domain", "host").distinct().count() <= min(MOST_HOSTS, MOST_NUMBERS // size):
        priors = F.broadcast(priors)
    fused = rows.join(priors, ["domain", "host"], "left").withColumn("score", _sum(F.col("score"), F.coalesce("prior", _logs(np.log(general)))))
    best = F.array_max("score")
    fused = fused.withColumn("confidence", F.when(F.col("strange"), 0.0).otherwise(1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - best))))
    empty = (F.col("n_trigrams") == 0) & ~F.col("heard")
    return fused.select(
        *(["kept.*"] if keep else []),
        F.get(F.array(*map(F.lit, names)), top(F.col("score")) - 1).alias("language"),
        "confidence",
        "n_trigrams",
        (empty | F.col("strange") | (F.col("confidence") < least_confidence)).alias("rejected"),
    )


# Second parts of addresses under which countries give names away; a domain has one part more there.
SHARED = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "ltd", "net", "nom", "or", "org", "plc", "sch")


def page_parts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with page_text, declared, host, domain and suffix: whole pages without scripts, styles and tags. Columns of
    pages that have one of these names are replaced. A domain is the host's last two parts, three where the last is a
    country's and the one before it is shared (x.co.uk). Null or broken addresses have null parts, null markup no text."""
    html, url = F.col(html_col).cast("string"), F.col(url_col).cast("string")
    none = lambda c: F.nullif(c, F.lit(""))
    host = none(F.lower(F.regexp_extract(url, "^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)))
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>|<!--.*?-->|<[^>]*>", " ")
    added = {
        "page_text": text,
        "declared": none(F.lower(F.regexp_extract(html, "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]{2,3})", 1))),
        "host": host,
        "domain": none(F.regexp_extract(host, "((?:[^.]+\\.(?:" + "|".join(SHARED) + ")\\.[a-z]{2})|(?:[^.]+\\.[^.]+))$", 1)),
        "suffix": none(F.regexp_extract(host, "\\.([^.]+)$", 1)),
    }
    return pages.select(*(c for c in pages.columns if c not in added), *(c.alias(n) for n, c in added.items()))
