"""Per-column statistics as DataFrames: range, cardinality, density, physical order and histogram.

One aggregation gives ranges and estimates; columns with few distinct values are counted exactly in a second. The physical
order is checked within chunks of the files in parallel and then between their ends. Empty tables have no statistics.
Cardinality, density and histogram have an exact form that counts all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the statistics
#: Distinct values up to which counts are exact; beyond, a HyperLogLog estimate of 2^12 registers.
EXACT_DISTINCT, RELATIVE_ERROR = 10_000, 0.0173
#: Rows a histogram is made from, its buckets, and the distinct strings up to which strings have one.
SAMPLE_ROWS, BUCKETS, MOST_STRINGS = 10_000, 10, 50
#: Consecutive rows of a file that one task checks for order; about as many a range of an exact histogram, in at most so many ranges.
CHUNK_ROWS, MOST_RANGES = 1 << 20, 1024
_BASIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType)


def _columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _BASIC)]


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _key(df: DataFrame, name: str) -> Column:
    """The value as text, equal where values are: zero has no sign, one NaN."""
    value = _quoted(name)
    if isinstance(df.schema[name].dataType, T.FloatType | T.DoubleType):
        value = F.when(value == 0, F.lit(0.0)).otherwise(value).cast(df.schema[name].dataType)
    return value.cast("string")


def _unpivot(row: DataFrame, entries: list[Column]) -> DataFrame:
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def value_range(df: DataFrame) -> DataFrame:
    """column_name, data_type, lower_int, upper_int (of whole numbers, else null), lower_real, upper_real (of reals, else null).

    No bound is cast to a type that cannot hold it. Strings have no range.
    """
    names = [c for c in _columns(df) if not _is_text(df, c)]
    if not names:
        return _empty(df, "column_name string, data_type string, lower_int bigint, upper_int bigint, lower_real double, upper_real double")
    bounds = [x for i, c in enumerate(names) for x in (F.min(_quoted(c)).alias(f"a{i}"), F.max(_quoted(c)).alias(f"b{i}"))]

    def entry(i: int, name: str) -> Column:
        real = isinstance(df.schema[name].dataType, T.FloatType | T.DoubleType)
        held = lambda bound, kind: F.col(bound).cast(kind) if real == (kind == "double") else F.lit(None).cast(kind)
        both = ((f"a{i}", "lower"), (f"b{i}", "upper"))
        values = [held(bound, kind).alias(f"{end}_{short}") for kind, short in (("bigint", "int"), ("double", "real")) for bound, end in both]
        return F.struct(F.lit(name).alias("column_name"), F.lit(df.schema[name].dataType.simpleString()).alias("data_type"), *values)

    return _unpivot(df.agg(*bounds), [entry(i, c) for i, c in enumerate(names)]).filter("lower_int is not null or lower_real is not null")


def cardinality(df: DataFrame, exact: bool = False) -> DataFrame:
    """column_name, cardinality. Counts beyond ``EXACT_DISTINCT`` are estimates (a relative deviation of ``RELATIVE_ERROR``), or with
    ``exact`` counts too."""
    return (_counted(df) if exact else _distinct(df)).select("column_name", "cardinality")


def density(df: DataFrame, exact: bool = False) -> DataFrame:
    """column_name, density: distinct values over rows, at most 1, in single precision."""
    counts = _counted(df) if exact else _distinct(df)
    share = F.least(F.lit(1.0), F.col("cardinality") / F.col("rows")).cast("float")
    return counts.select("column_name", share.alias("density"))


def _counted(df: DataFrame) -> DataFrame:
    """column_name, cardinality, rows, all counted: one distinct over (column, value)."""
    names = _columns(df)
    if not names:
        return _empty(df, "column_name string, cardinality bigint, rows bigint")
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), _key(df, c).alias("v")) for c in names))).alias("p")).select("p.*")
    counts = pairs.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column_name").agg(F.count("v").alias("cardinality"), F.sum("n").alias("rows"))


def _distinct(df: DataFrame) -> DataFrame:
    names = _columns(df)
    schema = "column_name string, cardinality bigint, rows bigint"
    if not names:
        return _empty(df, schema)
    first = df.agg(F.count("*"), *(F.approx_count_distinct(_quoted(c), RELATIVE_ERROR) for c in names)).first()
    if not first[0]:
        return _empty(df, schema)
    estimate = dict(zip(names, first[1:], strict=True))
    few = [c for c in names if estimate[c] <= EXACT_DISTINCT * (1 + 5 * RELATIVE_ERROR)]
    # one row for each distinct (column, value), so that several columns need no wide expansion
    exact = {}
    if few:
        pairs = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), _key(df, c).alias("v")) for i, c in enumerate(few)))).alias("p"))
        counted = pairs.select("p.*").filter("v is not null").distinct().groupBy("c").count()
        exact = {few[r["c"]]: r["count"] for r in counted.collect()}
    rows = [(c, n if (n := exact.get(c, 0)) and n <= EXACT_DISTINCT else estimate[c], first[0]) for c in names]
    return df.sparkSession.createDataFrame(rows, schema)


def _with_place(df: DataFrame) -> DataFrame:
    """Rows of a file source with their file and place in it; (file, place) is the physical order."""
    return df.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def physical_order(df: DataFrame) -> DataFrame:
    """column_name, is_physically_ordered: whether no row in file order is below the one before. df: a file source."""
    names = _columns(df)
    placed = _with_place(df).withColumn("__chunk", F.floor(F.col("__row") / CHUNK_ROWS))
    inside = Window.partitionBy("__file", "__chunk").orderBy("__row")
    falls = placed.select("__file", "__chunk", "__row", *(_quoted(c).alias(f"v{i}") for i, c in enumerate(names)))
    falls = falls.withColumns({f"f{i}": F.col(f"v{i}") < F.lag(f"v{i}").over(inside) for i in range(len(names))})
    ends = falls.groupBy("__file", "__chunk").agg(*(x for i in range(len(names)) for x in (F.max(F.coalesce(f"f{i}", F.lit(False))).alias(f"f{i}"), F.min_by(f"v{i}", "__row").alias(f"a{i}"), F.max_by(f"v{i}", "__row").alias(f"b{i}"))))
    between = Window.orderBy("__file", "__chunk")  # a row a chunk
    joined = ends.select(*((F.col(f"f{i}") | F.coalesce(F.col(f"a{i}") < F.lag(f"b{i}").over(between), F.lit(False))).alias(f"f{i}") for i in range(len(names))))
    any_fall = joined.agg(*(F.max(f"f{i}").alias(f"f{i}") for i in range(len(names))))
    entries = [F.struct(F.lit(c).alias("column_name"), (~F.col(f"f{i}")).alias("is_physically_ordered")) for i, c in enumerate(names)]
    return _unpivot(any_fall, entries).filter("is_physically_ordered is not null")


def histogram(df: DataFrame, seed: int = 7, exact: bool = False) -> DataFrame:
    """column_name, bucket (from 0), lower_bound, upper_bound (as strings), frequency.

    Equal-depth buckets over at most ``SAMPLE_ROWS`` rows (all, if fewer), scaled to the table; with ``exact`` over all rows, nulls
    last and never a bound of a bucket that holds values. Numbers always have one, strings only with few distinct values.
    """
    schema = "column_name string, bucket int, lower_bound string, upper_bound string, frequency bigint"
    if exact:
        total, texts = df.count(), [c for c in _columns(df) if _is_text(df, c)]
        most = {r["column_name"]: r["cardinality"] for r in _distinct(df.select(*map(_quoted, texts))).collect()} if texts else {}
        names = [c for c in _columns(df) if most.get(c, 0) <= MOST_STRINGS] if total else []
        cuts = _cuts(df, [c for c in names if c not in texts], total)
        return reduce(DataFrame.unionByName, (_over_all(df, c, total, cuts.get(c, [])) for c in names)) if names else _empty(df, schema)
    distinct = {r["column_name"]: (r["cardinality"], r["rows"]) for r in _distinct(df).collect()}
    names = [c for c in _columns(df) if c in distinct and (not _is_text(df, c) or distinct[c][0] <= MOST_STRINGS)]
    if not names:
        return _empty(df, schema)
    total = distinct[names[0]][1]
    sample = df.select(*map(_quoted, names))
    if total > SAMPLE_ROWS:  # drawn once for all columns: a bounded number of rows, thinned before it is sorted
        drawn = df.select(F.rand(seed).alias("__u"), *map(_quoted, names)).filter(F.col("__u") <= (1.2 * SAMPLE_ROWS + 100) / total)
        drawn = drawn.orderBy("__u").limit(SAMPLE_ROWS).drop("__u")
        sample = df.sparkSession.createDataFrame(drawn.collect(), drawn.schema)
    taken = min(total, SAMPLE_ROWS)
    depth = -(-taken // min(BUCKETS, taken))

    def of(name: str) -> DataFrame:
        place = F.row_number().over(Window.orderBy("v")) - 1  # at most SAMPLE_ROWS rows
        placed = sample.select(_quoted(name).alias("v")).withColumn("place", place)
        buckets = placed.groupBy(F.floor(F.col("place") / depth).cast("int").alias("bucket")).agg(F.min_by("v", "place").alias("a"), F.max_by("v", "place").alias("b"), F.count("*").alias("n"))
        scaled = F.floor(F.col("n") * F.lit(total) / taken).cast("bigint")
        return buckets.select(F.lit(name).alias("column_name"), "bucket", F.col("a").cast("string").alias("lower_bound"), F.col("b").cast("string").alias("upper_bound"), scaled.alias("frequency"))

    return reduce(DataFrame.unionByName, map(of, names))


def _cuts(df: DataFrame, names: list[str], total: int) -> dict[str, list]:
    """Column -> ascending values that part its rows into ranges of about ``CHUNK_ROWS``, at most ``MOST_RANGES``."""
    parts = min(MOST_RANGES, -(-total // CHUNK_ROWS))
    if parts < 2 or not names:
        return {}
    shares = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    found = df.agg(*(F.percentile_approx(_quoted(c), shares) for c in names)).first()
    return {c: sorted({v for v in values or [] if v == v}) for c, values in zip(names, found, strict=True)}


def _range_of(value: Column, cuts: list, first: int = 0) -> Column:
    """The number of cuts below the value, by bisection; NaN and null are above all."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(value <= F.lit(cuts[mid]), _range_of(value, cuts[:mid], first)).otherwise(_range_of(value, cuts[mid + 1 :], first + mid + 1))


def _over_all(df: DataFrame, name: str, total: int, cuts: list) -> DataFrame:
    """The buckets of all rows: distinct values with their counts are placed within ranges of values, and these after one another. A
    value lies in as many buckets as its places span, so a frequent one is a row like any other."""
    depth = -(-total // min(BUCKETS, total))
    counts = df.groupBy(_quoted(name).alias("v")).agg(F.count("*").alias("n")).withColumn("range", _range_of(F.col("v"), cuts))
    up_to = F.sum("n").over(Window.partitionBy("range").orderBy(F.col("v").asc_nulls_last()))
    placed = counts.withColumn("b", up_to)
    if cuts:
        before = counts.groupBy("range").agg(F.sum("n").alias("m")).select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("before"))  # a row a range
        placed = placed.join(F.broadcast(before), "range").withColumn("b", F.col("before") + F.col("b"))
    spans = placed.withColumn("a", F.col("b") - F.col("n")).select("v", "a", "b", F.explode(F.sequence(F.expr(f"a div {depth}"), F.expr(f"(b - 1) div {depth}"))).alias("bucket"))
    n = F.least("b", (F.col("bucket") + 1) * depth) - F.greatest("a", F.col("bucket") * depth)
    buckets = spans.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum(n).alias("frequency"))
    return buckets.select(F.lit(name).alias("column_name"), F.col("bucket").cast("int"), F.col("low").cast("string").alias("lower_bound"), F.col("high").cast("string").alias("upper_bound"), "frequency")


#: Tags of values in the catalog document. Fixed values of the format.
TAGS: dict[type, str] = {T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float32", T.DoubleType: "Float64", T.StringType: "String"}


def profile(df: DataFrame) -> dict[str, list]:
    """Column -> its statistics in the catalog's form, bounds tagged with their type. Physical order needs a file source, and is
    left out otherwise."""
    out: dict[str, list] = {c: [] for c in _columns(df)}

    def tagged(name: str, value: object) -> dict:
        kind = type(df.schema[name].dataType)
        read = {T.IntegerType: int, T.LongType: int, T.StringType: str}.get(kind, float)
        return {TAGS[kind]: read(value)}

    try:
        ordered = physical_order(df).filter("is_physically_ordered").collect()
    except Exception:  # no file behind the rows
        ordered = []
    for r in ordered:
        out[r["column_name"]].append("IsPhysicallyOrdered")
    for r in value_range(df).collect():
        c, kind = r["column_name"], "int" if r["lower_int"] is not None else "real"
        out[c].append({"RangeStat": {f"{end}_bound": tagged(c, r[f"{end}_{kind}"]) for end in ("lower", "upper")}})
    for r in _distinct(df).collect():
        out[r["column_name"]] += [{"CardinalityStat": r["cardinality"]}, {"DensityStat": min(1.0, r["cardinality"] / r["rows"])}]
    points: dict[str, list] = {}
    for r in histogram(df).orderBy("column_name", "bucket").collect():
        c = r["column_name"]
        points.setdefault(c, []).append([{f"{end}_bound": tagged(c, r[f"{end}_bound"]) for end in ("lower", "upper")}, r["frequency"]])
    for c, buckets in points.items():
        out[c].append({"HistogramStat": {"frequency_points": buckets}})
    return out
