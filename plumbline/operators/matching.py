"""Explainable matching of interfaces to queries: texts, feeds, vectors, and what the SQL itself says."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from plumbline.functions import text as tx
from plumbline.session import ship

# Similarity bands and their points.
BANDS = ((0.85, 25), (0.75, 20), (0.65, 15), (0.55, 10), (0.45, 5))
MOST_TEXT, MOST_VECTOR = 60, 25
#: Pairs of interfaces and queries that are compared at most.
MOST_PAIRS = 10_000_000_000
#: Rows, and components of their vectors, in a slice of queries or vectors at most; multiplications that are worth a task.
SLICE_ROWS, SLICE_COMPONENTS, TASK_PRODUCTS = 16_384, 1 << 20, 1 << 25
#: Products that are held at once.
HELD = 1 << 20
INTERFACE = ("application", "integration", "description", "type", "source_system", "target_system", "inbound_outbound")
QUERY = ("system", "file", "queryname", "tables", "sqltext", "type")


def sql_analysis(df: DataFrame, sql_col: str) -> DataFrame:
    """df with tables, n_joins, flags, case_blocks, where_conditions, sql_score and complexity of a query's text.

    Tables are sorted, as a set has no order. A null text has nothing."""
    raw = F.coalesce(F.col(sql_col).cast("string"), F.lit(""))
    up = F.upper(raw)
    named = lambda word: F.regexp_extract_all(up, F.lit(word + r"\s+([^\s,;()]+)"), F.lit(1))
    tables = F.array_sort(F.array_distinct(F.concat(named("FROM"), named("JOIN"))))
    joins = F.regexp_count(up, F.lit(r"\bJOIN\b"))
    where = F.regexp_extract(up, r"(?s)WHERE\s+(.+?)(?:GROUP BY|ORDER BY|LIMIT|HAVING|$)", 1)
    df = df.withColumn("sql_tables", tables).withColumn("n_joins", joins)
    df = df.withColumn("has_subquery", up.contains("(SELECT") | F.ltrim(F.regexp_replace(up, r"^\s+", "")).startswith("WITH "))
    df = df.withColumn("has_union", up.contains("UNION")).withColumn("has_group_by", up.contains("GROUP BY"))
    df = df.withColumn("has_case_when", up.contains("CASE") & up.contains("WHEN"))
    df = df.withColumn("case_blocks", F.slice(F.regexp_extract_all(raw, F.lit(r"(?is)CASE\s+.*?END"), F.lit(0)), 1, 3))
    df = df.withColumn("where_conditions", F.substring(where, 1, 300))
    points = lambda c, n: F.when(F.col(c), n).otherwise(0)
    score = F.size("sql_tables") * 2 + F.col("n_joins") * 3 + points("has_subquery", 10) + points("has_group_by", 5) + points("has_union", 5) + points("has_case_when", 5)
    return df.withColumn("sql_score", score).withColumn("complexity", F.when(score >= 25, "High").when(score >= 10, "Medium").otherwise("Low"))


def explanations(df: DataFrame) -> DataFrame:
    """df (an analysed match) with business_text and technical_text, by rule."""
    subject = {"customer": "customer or account data", "transaction": "transactions", "position": "positions and holdings", "balance": "balances to be reconciled", "general": "business data"}
    kind = tx.keyword_class(F.concat_ws(" ", "queryname", "description"))
    what = F.lit(subject["general"])
    for k, v in subject.items():
        what = F.when(kind == k, v).otherwise(what)
    business = F.concat(tx.safe("integration", "The interface"), F.lit(" moves "), what, F.lit(" from "), tx.safe("source_system", "an unknown source"), F.lit(" to "), tx.safe("target_system", "an unknown target"))
    flags = F.concat_ws(", ", F.when(F.col("has_subquery"), "subqueries"), F.when(F.col("has_union"), "unions"), F.when(F.col("has_group_by"), "grouping"), F.when(F.col("has_case_when"), "case rules"))
    technical = F.concat(tx.safe("queryname", "The query"), F.lit(" reads "), F.size("sql_tables").cast("string"), F.lit(" tables with "), F.col("n_joins").cast("string"), F.lit(" joins; "), F.when(flags == "", "no special constructs").otherwise(flags), F.lit("; complexity "), F.col("complexity"))
    return df.withColumn("business_text", business).withColumn("technical_text", technical)


def _words(c: Column, tokenized: bool) -> Column:
    return tx.words(c) if tokenized else F.filter(F.split(tx.normal(c), r"\s+"), lambda w: w != "")


def text_score(i: str, q: str, tokenized: bool = False) -> tuple[Column, Column]:
    """(points, reasons) of an interface's and a query's texts; columns are those of aliases i and q.

    Words are compared after blanks are gone, so that a name is one word; tokenized: words are cut first."""
    a = {c: tx.normal(F.col(f"{i}.{c}")) for c in INTERFACE}
    b = {c: tx.normal(F.col(f"{q}.{c}")) for c in QUERY}
    words = lambda c, own: _words(F.col(f"{own}.{c}"), tokenized)
    common = lambda c, d: tx.shared_words(words(c, i), words(d, q))
    name, in_query, in_file = a["integration"], tx.contains_either(a["integration"], b["queryname"]), tx.contains_either(a["integration"], b["file"])
    by_words = lambda n, each, most, given: F.when(given & (n > 0), F.least(n * each, F.lit(most))).otherwise(0)
    both = lambda x, y: (x != "") & (y != "")
    n_query, n_file, n_desc = common("integration", "queryname"), common("integration", "file"), common("description", "queryname")
    rules = [
        ("application is the system", F.when(tx.contains_either(a["application"], b["system"]), 15).otherwise(0)),
        ("name in query name", F.when(in_query, 15).otherwise(by_words(n_query, 4, 10, both(name, b["queryname"])))),
        ("name in file name", F.when(in_file, 5).otherwise(by_words(n_file, 2, 5, both(name, b["file"])))),
        ("source among tables", F.when(both(a["source_system"], b["tables"]) & b["tables"].contains(a["source_system"]), 10).otherwise(0)),
        ("type", F.when(both(a["type"], b["type"]) & b["type"].contains(a["type"]), 5).otherwise(0)),
        ("description words", by_words(n_desc, 2, 10, both(a["description"], b["queryname"]))),
    ]
    total = sum((p for _, p in rules[1:]), rules[0][1])
    reasons = F.concat_ws("; ", *(F.when(p > 0, F.concat(F.lit(f"{n} +"), p.cast("string"))) for n, p in rules))
    return F.least(total, F.lit(MOST_TEXT)), reasons


def feed_penalties(interfaces: DataFrame, feeds: DataFrame, key: str) -> DataFrame:
    """key, step2_score, matched_feeds: -10 where any feed that shares the source or the target flows the other way.

    Feeds are few and interfaces are metadata: each distinct pair of systems and direction is compared once."""
    low = lambda c: F.lower(tx.safe(c))
    a = interfaces.select(F.col(key), low("source_system").alias("s"), low("target_system").alias("t"), low("inbound_outbound").alias("d"))
    side = F.coalesce(F.nullif(low("direction_to_hub"), F.lit("")), low("direction_to_app"))
    f = feeds.select(low("source_system").alias("fs"), low("target_system").alias("ft"), side.alias("fd")).distinct()
    kinds = a.select("s", "t", "d").distinct()
    hit = ((F.col("s") != "") & F.col("fs").contains(F.col("s"))) | ((F.col("t") != "") & F.col("ft").contains(F.col("t")))
    against = (F.col("d").contains("inbound") & F.col("fd").contains("outbound")) | (F.col("d").contains("outbound") & F.col("fd").contains("inbound"))
    found = kinds.join(f, hit).groupBy("s", "t", "d").agg(F.count(F.lit(1)).alias("matched_feeds"), F.max(F.when(against, 1).otherwise(0)).alias("bad"))
    out = a.join(found, ["s", "t", "d"], "left")
    return out.select(key, F.when(F.col("bad") == 1, -10).otherwise(0).alias("step2_score"), F.coalesce("matched_feeds", F.lit(0)).alias("matched_feeds"))


def match(interfaces: DataFrame, queries: DataFrame, feeds: DataFrame | None = None, min_score: int = 40, tokenized: bool = False, vector_col: str = "embedding", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Every pair of an interface and a query with a final score of min_score or more.

    interfaces has interface_id, queries query_id; both may have a vector each, of unit length. A pair can gain 25 points
    by its vectors at the most and lose some by its feeds: pairs whose texts are too far off are dropped before that,
    which loses none. Scoring rules compare every interface with every query, both of them lists of metadata: more than
    ``most_pairs`` pairs are refused."""
    pairs = interfaces.count() * queries.count()
    if pairs > most_pairs:
        raise ValueError(f"{pairs} pairs of interfaces and queries are more than {most_pairs}: match parts of them")
    a, b = interfaces.alias("i"), queries.alias("q")
    points, reasons = text_score("i", "q", tokenized)
    pairs = a.join(b, F.lit(True)).withColumn("step1_score", points).withColumn("step1_details", reasons)
    pairs = pairs.filter(F.col("step1_score") >= min_score - MOST_VECTOR)
    if vector_col in interfaces.columns and vector_col in queries.columns:
        similarity = tx.dot(F.col(f"i.{vector_col}"), F.col(f"q.{vector_col}"))
    else:
        similarity = F.lit(None).cast("double")
    pairs = pairs.withColumn("semantic_similarity", F.coalesce(similarity, F.lit(0.0))).withColumn("step3_score", F.when(similarity.isNull(), 0).otherwise(tx.banded(F.col("semantic_similarity"), BANDS)))
    penalty = feed_penalties(interfaces, feeds, "interface_id") if feeds is not None else None
    keep = ["i.interface_id", "q.query_id", *(f"i.{c}" for c in INTERFACE), F.col("q.system").alias("sql_system"), F.col("q.file").alias("sql_file"), "q.queryname", "q.tables", "q.sqltext", "step1_score", "step3_score", "semantic_similarity", "step1_details"]
    out = pairs.select(*keep)
    out = out.join(penalty, "interface_id", "left") if penalty is not None else out.withColumn("step2_score", F.lit(0)).withColumn("matched_feeds", F.lit(0))
    final = F.greatest(F.lit(0), F.least(F.lit(100), F.col("step1_score") + F.coalesce("step2_score", F.lit(0)) + F.col("step3_score")))
    out = out.withColumn("final_score", final).filter(F.col("final_score") >= min_score)
    sure = F.when((F.col("step1_score") >= 30) & (F.col("final_score") >= 70), "HIGH").when((F.col("step1_score") >= 15) & (F.col("final_score") >= 45), "MEDIUM").otherwise("LOW")
    details = F.concat_ws(" | ", F.col("step1_details"), F.format_string("feeds %d", "step2_score"), F.format_string("vectors %d", "step3_score"))
    return out.withColumn("confidence", sure).withColumn("match_details", details).drop("step1_details")


def _in_order(u, v):
    """Scalar products of rows of equal number, added up from the first component to the last, as ``tx.dot`` does."""
    import numpy as np

    out = np.zeros(len(u))
    with np.errstate(all="ignore"):
        for k in range(u.shape[1]):
            out += u[:, k] * v[:, k]
    return out


def _levels(u, v, same_u, same_v, borders):
    """How many pairs of rows of u and v reach 0, 1, 2, ... of the ascending borders, those below all of them left out.

    A matrix product adds up in an order of its own: what it says holds unless rounding could carry a pair over a border,
    and those pairs are added up again in order. Rows v are taken by length, so that a few very long ones, or ones that
    aren't finite, widen that margin only for their own block. same_u, same_v: numbers of the ids, pairs of equal ones
    don't count."""
    import numpy as np

    dim, out = u.shape[1], np.zeros(len(borders) + 1, np.int64)
    with np.errstate(all="ignore"):
        long_u, long_v = np.sqrt((u * u).sum(1)), np.sqrt((v * v).sum(1))
        order = np.argsort(long_v, kind="stable")
        v, same_v, long_v = v[order], same_v[order], long_v[order]
        step, few = 2048, max(1, HELD // max(1, dim))
        for b in range(0, len(v), step):
            mine, ids = v[b : b + step], same_v[b : b + step]
            # Either sum is off by dim * eps / 2 of the lengths' product at most, and what underflows; it can't overflow below 1e300.
            product = long_u * long_v[b : b + step].max()
            margin = np.where(product < 1e300, 4 * (dim + 1) * np.finfo(float).eps * product + 1e-300, np.inf)
            for a in range(0, len(u), max(1, HELD // step)):
                some = slice(a, a + max(1, HELD // step))
                x, near = u[some] @ mine.T, margin[some]
                hit = ~(x < (borders[0] - near)[:, None])
                if (shared := np.flatnonzero(np.isin(ids, same_u[some]))).size:
                    hit[:, shared] &= same_u[some][:, None] != ids[shared]
                at_hit = np.flatnonzero(hit)
                found, (i, j) = x.ravel()[at_hit], np.divmod(at_hit, len(mine))
                unsure = np.zeros(len(found), bool)
                for at in borders:
                    unsure |= ~(np.abs(found - at) > near[i])
                unsure = np.flatnonzero(unsure)
                for k in range(0, len(unsure), few):
                    now = unsure[k : k + few]
                    found[now] = _in_order(u[some][i[now]], mine[j[now]])
                level = np.zeros(len(found), np.int64)
                for at in borders:
                    level += ~(found < at)  # NaN is above all numbers
                out += np.bincount(level, minlength=len(out))
    out[0] = 0
    return out


def _cell_counts(table, bands, below):
    """points and n_pairs of one slice of queries (asked) and one of vectors."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    bands = sorted(bands)
    borders, points = [float(at) for at, _ in bands], [below, *(p for _, p in bands)]
    table = table.combine_chunks()
    ids = pc.dictionary_encode(table.column("id").combine_chunks()).indices.to_numpy()
    asked = table.column("asked").to_numpy()
    vector = table.column("vector").combine_chunks()
    dims = pc.fill_null(pc.list_value_length(vector), -1).to_numpy()
    held = np.bincount(ids, minlength=1)
    by_query = np.bincount(ids[asked], minlength=len(held))
    others = held - by_query
    counts = np.zeros(len(points), np.int64)
    for dim in np.unique(dims[asked]):
        u, v = np.flatnonzero(asked & (dims == dim)), np.flatnonzero(~asked & (dims == dim))
        if dim >= 0 and len(u) and len(v):
            rows = lambda at: vector.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
            counts += _levels(rows(u), rows(v), ids[u], ids[v], borders)
    counts[0] = by_query.sum() * others.sum() - (by_query * others).sum() - counts.sum()
    some = np.flatnonzero(counts)
    return pa.table([pa.array(np.array(points)[some], pa.int32()), pa.array(counts[some])], names=["points", "n_pairs"])


def band_counts(queries: DataFrame, vectors: DataFrame, bands: tuple[tuple[float, int], ...] = BANDS, below: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """points, n_pairs: how many pairs of a query and a vector of another id have so many points by their scalar product,
    in double precision from the first component to the last. Points that no pair has are left out.

    Every pair is looked at: both sides are cut into slices, and each slice of queries meets each slice of vectors in a
    task of its own, as a product of matrices; no task holds more than two slices, which only rows equal in id and vector
    don't divide. Vectors that are null, hold nulls or are of unequal length have the points ``below``; NaN is above all
    numbers; rows with null ids are in no pair."""
    spark = vectors.sparkSession
    ship(spark)

    def sides(df: DataFrame) -> DataFrame:
        stored = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
        vector = F.col(vector_col).cast(stored)
        whole = F.when(F.forall(vector, lambda x: x.isNotNull()), vector)
        return df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), whole.alias("vector"))

    asked, others = sides(queries), sides(vectors)
    (n_asked, dim), (n_others, dim_others) = (df.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first() for df in (asked, others))
    dim = max(1, dim or 1, dim_others or 1)
    most = max(1, min(SLICE_ROWS, SLICE_COMPONENTS // dim))
    columns = max(1, -(-n_asked // most))
    worth = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_asked * n_others * dim // TASK_PRODUCTS))
    slices = max(1, -(-n_others // most), -(-worth // columns))
    mark = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("id", "vector", F.lit(True).alias("asked"), mark(columns).alias("c"), every(slices).alias("r"))
    others = others.select("id", "vector", F.lit(False).alias("asked"), mark(slices).alias("r"), every(columns).alias("c"))
    dealt = asked.unionByName(others).select("id", "vector", "asked", (F.col("r") * columns + F.col("c")).alias("cell"))
    dealt = dealt.repartitionById(slices * columns, F.col("cell"))

    def counted(table):
        return _cell_counts(table, bands, below)

    found = dealt.groupBy("cell").applyInArrow(counted, "points int, n_pairs long")
    return found.groupBy("points").agg(F.sum("n_pairs").alias("n_pairs"))


def audit_entries(matches: DataFrame, at: datetime) -> DataFrame:
    """An entry of the audit log (at, action, details) for each match."""
    details = F.format_string("interface %s, query %s: %d (%s)", F.col("interface_id").cast("string"), F.col("query_id").cast("string"), F.col("final_score").cast("int"), F.col("confidence"))
    return matches.select(F.lit(at).alias("at"), F.lit("match").alias("action"), details.alias("details"))


def asked(df: DataFrame, prompt_col: str, answer: Callable[[list[str]], list[str | None]], name: str, batch: int = 32) -> DataFrame:
    """df with a model's answers to its prompts, a column that only annotates: nothing is scored by it. The model is
    loaded where ``answer`` runs, on executors; without an answer the text stays null."""

    def run(batches):
        for b in batches:
            texts = b[prompt_col].fillna("").tolist()
            b[name] = [x for at in range(0, len(texts), batch) for x in answer(texts[at : at + batch])]
            yield b

    kept = df.drop(name)
    return kept.mapInPandas(run, StructType([*kept.schema.fields, StructField(name, StringType())]))


def encoded(df: DataFrame, encode: Callable[[list[str]], list[list[float]]], name: str = "embedding", batch: int = 32) -> DataFrame:
    """df (with encoding_text) with a model's vectors, scaled to unit length; a vector of zeros stays as it is."""

    def run(batches):
        import numpy as np

        for b in batches:
            texts = b["encoding_text"].tolist()
            found = [np.asarray(v, float) for at in range(0, len(texts), batch) for v in encode(texts[at : at + batch])]
            b[name] = [(v / (np.linalg.norm(v) or 1.0)).tolist() for v in found]
            yield b

    kept = df.drop(name)
    return kept.mapInPandas(run, StructType([*kept.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def confidence_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("confidence").agg(F.count(F.lit(1)).alias("n_matches"))


def ranked(matches: DataFrame) -> DataFrame:
    return matches.orderBy(F.desc("final_score"), "interface_id", "query_id")


def top(matches: DataFrame, n: int = 20) -> DataFrame:
    """The first n of the ranked matches, for a report."""
    return ranked(matches).limit(n)


def filtered(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose values are wanted, for each column with any wanted values."""
    for c, values in wanted.items():
        if values:
            df = df.filter(F.col(c).isin(list(values)))
    return df


def options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def encoding_text(df: DataFrame, columns: list[str], limits: dict[str, int] | None = None) -> DataFrame:
    """df with encoding_text, what a model is given for a row; ``unknown`` if there is nothing."""
    parts = [F.substring(tx.safe(c), 1, (limits or {}).get(c, 1 << 30)) for c in columns]
    joined = F.trim(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " "))
    return df.withColumn("encoding_text", F.when(joined == "", "unknown").otherwise(joined))


# Lineage graph


def lineage_edges(matches: DataFrame) -> DataFrame:
    """src, dst: interface to its systems, the target (else the source) to the query, the query to its first five tables."""
    integ, src, tgt = tx.safe("integration", "?"), tx.safe("source_system", "?src"), tx.safe("target_system", "?tgt")
    query = tx.safe("queryname")
    edge = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    fixed = F.array(edge(integ, src), edge(integ, tgt), F.when(query != "", edge(F.when(tgt != "?tgt", tgt).otherwise(src), query)))
    tables = F.when(query != "", F.filter(F.transform(F.slice(F.split(tx.safe("tables"), ","), 1, 5), lambda x: F.trim(x)), lambda x: (x != "") & (x != "nan")))
    out = F.concat(F.array_compact(fixed), F.coalesce(F.transform(tables, lambda t: edge(query, t)), F.array().cast("array<struct<src:string,dst:string>>")))
    return matches.select(F.inline(out)).distinct()


def lineage_nodes(matches: DataFrame) -> DataFrame:
    """id, ntype. A name with several roles has the last one that its rows give it, tables last."""
    node = lambda c, kind, rank: F.when(c != "", F.struct(c.alias("id"), F.lit(kind).alias("ntype"), F.lit(rank).alias("rank")))
    query = tx.safe("queryname")
    fixed = F.array(node(tx.safe("integration", "?"), "interface", 0), node(tx.safe("source_system", "?src"), "source", 1), node(tx.safe("target_system", "?tgt"), "target", 2), node(query, "sql", 3))
    tables = F.when(query != "", F.filter(F.transform(F.slice(F.split(tx.safe("tables"), ","), 1, 5), lambda x: F.trim(x)), lambda x: (x != "") & (x != "nan")))
    listed = F.transform(tables, lambda t: F.struct(t.alias("id"), F.lit("table").alias("ntype"), F.lit(4).alias("rank")))
    every = F.concat(F.array_compact(fixed), F.coalesce(listed, F.array().cast("array<struct<id:string,ntype:string,rank:int>>")))
    return matches.select(F.inline(every)).groupBy("id").agg(F.max_by("ntype", "rank").alias("ntype"))


def layout(nodes: DataFrame) -> DataFrame:
    """nodes with x and y for drawing: a column of the picture for each type, in the order in which data flows, names from
    top to bottom and centred. The same graph is always drawn alike."""
    kinds = ("source", "interface", "target", "sql", "table")
    column = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("ntype")), F.lit(0))
    place, all_ = Window.partitionBy("ntype").orderBy("id"), Window.partitionBy("ntype")
    y = F.row_number().over(place) - (F.count(F.lit(1)).over(all_) + 1) / 2
    return nodes.select("*", column.cast("double").alias("x"), y.cast("double").alias("y"))
