"""Column profiling and role detection.

One shuffle builds a value histogram of every column (unpivot to
``(column_name, value)`` then ``groupBy().count()`` with map-side combine);
distinct counts, missing counts, top values, boolean tokens, text lengths and
date-parse shares all come from it. Numeric statistics are one fused ``agg``.
Role rules are column expressions over the per-column facts, so the whole
profile is a handful of Spark jobs whatever the number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.dates import parse_datetime, time_column
from veritable.functions.exprs import is_numeric_type, is_time_type, scalar_columns

# Name patterns, tokens and thresholds of the role rules.
IDENTIFIER_PATTERN = r"(?i)(^|[_\s])(id|ids|key|code|no|num|number|ref|reference|uuid|guid|sku|barcode)([_\s]|$)"
DATE_NAME_PATTERN = r"(?i)(date|time|day|month|year|timestamp|created|updated|ordered|shipped|due|period)"
MONEY_NAME_PATTERN = (
    r"(?i)(revenue|sales|amount|price|cost|profit|margin|total|value|spend|income|"
    r"expense|charge|fee|payment|discount|tax|salary|budget)"
)
QUANTITY_NAME_PATTERN = r"(?i)(quantity|qty|units|count|volume|items|pieces|orders|visits|clicks)"
BOOLEAN_TOKEN_PAIRS = (("true", "false"), ("yes", "no"), ("y", "n"), ("1", "0"), ("t", "f"))
CALENDAR_LABEL_NAMES = ("year", "month", "quarter", "week", "day", "month_name", "day_of_week", "weekday")
SIGNED_MEASURE_WORDS = (
    "latitude", "longitude", "temperature", "temp", "change", "delta", "difference",
    "deviation", "balance", "profit", "loss", "elevation", "altitude", "coordinate",
)
DATE_PARSE_THRESHOLD = 0.8
IDENTIFIER_UNIQUE_RATIO = 0.9
LOW_CARDINALITY_NUMERIC = 12
TOP_VALUES = 8

ROLES = ("identifier", "datetime", "measure", "category", "boolean", "text", "constant", "unknown")


def type_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if is_numeric_type(dtype):
        return "numeric"
    if is_time_type(dtype):
        return "time"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return "other"


def schema_table(df: DataFrame) -> DataFrame:
    """Column metadata as a small DataFrame (bounded by the column count)."""
    rows = [(i, f.name, f.dataType.simpleString(), type_kind(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, dtype string, kind string"
    )


def _flat_columns(df: DataFrame, columns: list[str] | None) -> list[str]:
    names = columns or df.columns
    return [n for n in names if type_kind(df.schema[n].dataType) != "other"]


def histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value, cnt)`` for every value of every column, NULL included."""
    names = _flat_columns(df, columns)
    as_text = df.select(*[F.col(n).cast("string").alias(n) for n in names])
    long = as_text.unpivot([], names, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def column_facts(df: DataFrame, columns: list[str] | None = None, hist: DataFrame | None = None) -> DataFrame:
    """Per-column facts behind the role rules.

    Numeric columns are counted on their typed values (no text formatting of
    every number); text, time and boolean columns on their text form. Each is
    one unpivot + grouped count with map-side combine.
    """
    names = _flat_columns(df, columns)
    if hist is not None:
        return text_facts(df, hist)
    numeric = [n for n in names if type_kind(df.schema[n].dataType) == "numeric"]
    other = [n for n in names if n not in numeric]
    parts = []
    if other:
        parts.append(text_facts(df, histogram(df, other)))
    if numeric:
        parts.append(numeric_facts(df, typed_histogram(df, numeric)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def typed_histogram(df: DataFrame, names: list[str], *keys: Column) -> DataFrame:
    """``(column_name, w, f, d, cnt)``, after ``keys``: numbers counted in their own type, whole numbers as bigint
    (w), floats as double (f), decimals exactly (d)."""
    def value(n: str, whole: bool, decimal: bool) -> Column:
        kind = df.schema[n].dataType
        is_whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        is_decimal = isinstance(kind, T.DecimalType)
        mine = (is_whole, is_decimal) == (whole, decimal)
        target = "bigint" if whole else "string" if decimal else "double"
        return F.col(n).cast(target) if mine else F.lit(None).cast(target)

    parts = [F.struct(F.lit(n).alias("column_name"), value(n, True, False).alias("w"), value(n, False, False).alias("f"),
                      value(n, False, True).alias("d")) for n in names]
    marks = [f"_key{i}" for i in range(len(keys))]
    long = df.select(*[k.alias(m) for k, m in zip(keys, marks, strict=True)], F.explode(F.array(*parts)).alias("s")).select(*marks, "s.*")
    return long.groupBy(*marks, "column_name", "w", "f", "d").agg(F.count(F.lit(1)).alias("cnt"))


def numeric_facts(df: DataFrame, hist: DataFrame) -> DataFrame:
    """Facts of the columns of a typed histogram."""
    c = F.col("cnt")
    nn = F.col("w").isNotNull() | F.col("f").isNotNull() | F.col("d").isNotNull()
    # a whole-number column holding only 0/1 prints as the tokens "0"/"1"
    zero_one = F.coalesce(F.col("w").isin(0, 1), F.lit(False))
    facts = hist.groupBy("column_name").agg(
        F.sum(c).alias("n_rows"), F.sum(F.when(nn, c).otherwise(0)).alias("non_null"),
        F.sum(F.when(nn, 1).otherwise(0)).alias("distinct_count"),
        F.sum(F.when(zero_one, 1).otherwise(0)).alias("zero_one"))
    facts = facts.join(F.broadcast(schema_table(df)), "column_name")   # one row per column: bounded
    dc, non_null = F.col("distinct_count"), F.col("non_null")
    return facts.select(
        "position", "column_name", "dtype", "kind",
        F.col("n_rows").cast("bigint").alias("n_rows"), non_null.cast("bigint").alias("non_null"),
        (F.col("n_rows") - non_null).cast("bigint").alias("missing_count"), dc.cast("bigint").alias("unique_count"),
        F.lit(None).cast("double").alias("avg_length"),
        ((dc >= 1) & (dc <= 2) & (F.col("zero_one") == dc)).alias("bool_like"),
        F.lit(0.0).alias("bare_number_share"), F.lit(0.0).alias("calendar_word_share"), F.lit(0.0).alias("parsed_share"),
    )


def text_facts(df: DataFrame, hist: DataFrame) -> DataFrame:
    """Facts from a text histogram (column_name, value, cnt)."""
    v, c = F.col("value"), F.col("cnt")
    nn = v.isNotNull()
    # Date shares only matter for text columns with a date-like name; parsing
    # is the costliest expression, so it runs on those histogram rows only.
    import re as _re

    date_cands = [f.name for f in df.schema.fields
                  if type_kind(f.dataType) == "text" and _re.search(DATE_NAME_PATTERN, f.name)]
    is_cand = F.col("column_name").isin(*date_cands) if date_cands else F.lit(False)
    token = F.lower(F.trim(v))
    pair_hits = [
        F.sum(F.when(nn & token.isin(*pair), 1).otherwise(0)).alias(f"pair_{i}")
        for i, pair in enumerate(BOOLEAN_TOKEN_PAIRS)
    ]
    facts = hist.groupBy("column_name").agg(
        F.sum(c).alias("n_rows"),
        F.sum(F.when(nn, c).otherwise(0)).alias("non_null"),
        F.sum(F.when(nn, 1).otherwise(0)).alias("distinct_count"),
        F.sum(F.when(nn, F.length(v) * c).otherwise(0)).alias("len_total"),
        F.sum(F.when(nn & is_cand & F.trim(v).rlike(r"^\d+(\.\d+)?$"), c).otherwise(0)).alias("bare_numbers"),
        F.sum(F.when(nn & is_cand & F.lower(F.trim(v)).isin(*_calendar_words()), c).otherwise(0)).alias("calendar_words"),
        F.sum(F.when(nn & is_cand & parse_datetime(v).isNotNull(), c).otherwise(0)).alias("parsed_dates"),
        *pair_hits,
    )
    meta = F.broadcast(schema_table(df))  # one row per column: bounded
    facts = facts.join(meta, "column_name")
    dc = F.col("distinct_count")
    bool_like = (dc >= 1) & (dc <= 2) & F.greatest(
        *[F.col(f"pair_{i}") == dc for i in range(len(BOOLEAN_TOKEN_PAIRS))]
    )
    non_null = F.col("non_null")
    return facts.select(
        "position", "column_name", "dtype", "kind",
        F.col("n_rows").cast("bigint").alias("n_rows"),
        non_null.cast("bigint").alias("non_null"),
        (F.col("n_rows") - non_null).cast("bigint").alias("missing_count"),
        dc.cast("bigint").alias("unique_count"),
        F.when(non_null > 0, F.col("len_total") / non_null).alias("avg_length"),
        bool_like.alias("bool_like"),
        F.when(non_null > 0, F.col("bare_numbers") / non_null).alias("bare_number_share"),
        F.when(non_null > 0, F.col("calendar_words") / non_null).alias("calendar_word_share"),
        F.when(non_null > 0, F.col("parsed_dates") / non_null).alias("parsed_share"),
    )


def _calendar_words():
    from veritable.functions.dates import MONTH_AND_DAY_WORDS

    return MONTH_AND_DAY_WORDS


def role_expr() -> Column:
    """Ordered role rules (R1) as one CASE over the facts columns."""
    name = F.col("column_name")
    kind = F.col("kind")
    dc = F.col("unique_count")
    nn = F.col("non_null")
    ratio = dc / nn
    id_like = name.rlike(IDENTIFIER_PATTERN)
    dates_ok = (
        name.rlike(DATE_NAME_PATTERN)
        & (F.col("bare_number_share") <= 0.5)
        & (F.col("calendar_word_share") <= 0.5)
        & (F.col("parsed_share") >= DATE_PARSE_THRESHOLD)
    )
    numeric_role = (
        F.when(id_like & (ratio >= IDENTIFIER_UNIQUE_RATIO), "identifier")
        .when(
            id_like & (dc <= LOW_CARDINALITY_NUMERIC)
            & ~name.rlike(MONEY_NAME_PATTERN) & ~name.rlike(QUANTITY_NAME_PATTERN),
            "category",
        )
        .otherwise("measure")
    )
    text_role = (
        F.when(dates_ok, "datetime")
        .when(id_like & (ratio >= IDENTIFIER_UNIQUE_RATIO), "identifier")
        .when((ratio > 0.5) & (F.col("avg_length") > 30), "text")
        .when(ratio >= IDENTIFIER_UNIQUE_RATIO, "identifier")
        .when((dc <= 60) | (ratio < 0.35), "category")
        .otherwise("text")
    )
    return (
        F.when(nn == 0, "unknown")
        .when(dc == 1, "constant")
        .when(F.lower(name).isin(*CALENDAR_LABEL_NAMES), "category")
        .when((kind == "bool") | F.col("bool_like"), "boolean")
        .when(kind == "time", "datetime")
        .when(kind == "numeric", numeric_role)
        .when(kind == "other", "unknown")
        .otherwise(text_role)
    )


def few_valued(df: DataFrame, most: int) -> list[str]:
    """Columns that may have at most ``most`` distinct values, from one pass; the others certainly have more.

    A HyperLogLog sketch counts few values by its registers that are still
    empty: k values fill at most k of them, so it never says much more than k.
    """
    names = _flat_columns(df, None)
    if not names:
        return []
    counts = df.agg(*[F.approx_count_distinct(F.col(n)).alias(f"c{i}") for i, n in enumerate(names)]).first()  # one row
    return [n for i, n in enumerate(names) if counts[f"c{i}"] <= 1.5 * most + 5]


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, kind, unique_count, n_rows) of columns with few values (``few_valued``): their values are held as sets."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.size(F.collect_set(F.col(c))).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(type_kind(df.schema[c].dataType)).alias("kind"),
                     F.col(f"c{i}").cast("bigint").alias("unique_count"), F.col("n").alias("n_rows")) for i, c in enumerate(columns)]
    return counts.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def detect_roles(df: DataFrame, roles: dict[str, str] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Facts plus a ``role`` column; explicit ``roles`` override the rules."""
    facts = facts if facts is not None else column_facts(df)
    role = role_expr()
    for name, forced in (roles or {}).items():
        role = F.when(F.col("column_name") == name, F.lit(forced)).otherwise(role)
    return facts.withColumn("role", role)


def roles_dict(profile_df: DataFrame) -> dict[str, str]:
    """Collect the role column (one row per column: bounded by the schema)."""
    return {r["column_name"]: r["role"] for r in profile_df.select("column_name", "role").collect()}


def measure_flavour(name: str) -> str:
    import re

    if re.search(MONEY_NAME_PATTERN, name):
        return "money"
    if re.search(QUANTITY_NAME_PATTERN, name):
        return "quantity"
    return "value"


def numeric_stats(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """R5 for many columns, returned long.

    min, max, mean, median, std (ddof 1), sum, zeros, negatives and the
    bias-adjusted skew (pandas ``skew``) for n > 2. Everything but the median
    is one fused aggregation; medians are exact global quantiles (fused
    ``percentile`` for low-cardinality columns, the bounded bracket method
    above that; ``exact=False`` uses a sketch).
    """
    from veritable.functions.quantiles import global_quantiles

    aggs = []
    for i, name in enumerate(columns):
        x = F.col(name).try_cast("double")
        aggs += [
            F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
            F.avg(x).alias(f"av{i}"), F.stddev_samp(x).alias(f"sd{i}"),
            F.sum(x).alias(f"sm{i}"), F.count_if(x == 0).alias(f"z{i}"), F.count_if(x < 0).alias(f"ng{i}"),
            F.skewness(x).alias(f"sk{i}"),
        ]
    # declarative aggregates only, so the pass stays in whole-stage codegen
    # (a sketch such as approx_count_distinct here would take it out)
    wide_row = df.agg(*aggs).first()          # one row: bounded
    if exact:
        med = global_quantiles(df, {c: [0.5] for c in columns},
                               counts={c: int(wide_row[f"n{i}"]) for i, c in enumerate(columns)})
    else:
        r = df.agg(*[F.percentile_approx(F.col(c).try_cast("double"), 0.5, 100000).alias(c) for c in columns]).first()
        med = {c: [r[c]] for c in columns}
    rows = [(name, wide_row[f"n{i}"], wide_row[f"mn{i}"], wide_row[f"mx{i}"], wide_row[f"av{i}"], med[name][0],
             wide_row[f"sd{i}"], wide_row[f"sm{i}"], wide_row[f"z{i}"], wide_row[f"ng{i}"], wide_row[f"sk{i}"])
            for i, name in enumerate(columns)]
    long = df.sparkSession.createDataFrame(
        rows, "column_name string, n bigint, min double, max double, mean double, median double, std double, "
              "sum double, zeros bigint, negatives bigint, g1 double")
    n = F.col("n").cast("double")
    adjusted = F.when(
        n > 2,
        F.when(F.coalesce(F.col("std"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
            F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
        ),
    )
    return long.select(
        "column_name", F.col("n").cast("bigint").alias("n"), "min", "max", "mean", "median",
        F.coalesce(F.col("std"), F.lit(0.0)).alias("std"), "sum",
        F.col("zeros").cast("bigint").alias("zeros"), F.col("negatives").cast("bigint").alias("negatives"),
        adjusted.alias("skew"),
    )


def category_stats(hist: DataFrame, columns: list[str] | None = None, top: int = TOP_VALUES) -> DataFrame:
    """Top values (count desc, value asc), top share and distinct count.

    Works on the histogram: per column a top-k (``orderBy().limit()``, a
    per-partition top-k and merge, so a column with billions of distinct
    values is never sorted in one task) and one partially aggregated summary.
    """
    h = hist.filter(F.col("value").isNotNull())
    names = columns or [r["column_name"] for r in h.select("column_name").distinct().collect()]  # bounded by schema
    if not names:
        return hist.sparkSession.createDataFrame(
            [], "column_name string, rank int, value string, cnt bigint, distinct_count bigint, top_share double")
    summary = h.filter(F.col("column_name").isin(*names)).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.sum("cnt").alias("non_null"), F.max("cnt").alias("top_cnt"))
    heads = None
    for name in names:
        head = (h.filter(F.col("column_name") == name).orderBy(F.col("cnt").desc(), F.col("value").asc())
                .limit(top).select("column_name", "value", "cnt"))
        heads = head if heads is None else heads.unionByName(head)
    from pyspark.sql import Window as W

    ranked = heads.select("*", F.row_number().over(
        W.partitionBy("column_name").orderBy(F.col("cnt").desc(), F.col("value").asc())).alias("rank"))  # <= top rows each
    return ranked.join(F.broadcast(summary), "column_name").select(
        "column_name", F.col("rank").cast("int").alias("rank"), "value", F.col("cnt").cast("bigint").alias("cnt"),
        F.col("distinct_count").cast("bigint").alias("distinct_count"),
        F.round(F.col("top_cnt") / F.col("non_null"), 4).alias("top_share"),
    )


def datetime_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """earliest/latest date and span in whole days of the timestamp gap."""
    rows = []
    aggs = []
    for i, name in enumerate(columns):
        ts = time_column(df, name)
        aggs += [F.min(ts).alias(f"a{i}"), F.max(ts).alias(f"b{i}")]
        rows.append(F.struct(F.lit(name).alias("column_name"), F.col(f"a{i}").cast("timestamp").alias("lo"),
                             F.col(f"b{i}").cast("timestamp").alias("hi")))
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    seconds = F.unix_micros(F.col("hi")) - F.unix_micros(F.col("lo"))
    return long.select(
        "column_name",
        F.date_format("lo", "yyyy-MM-dd").alias("earliest"),
        F.date_format("hi", "yyyy-MM-dd").alias("latest"),
        F.floor(seconds / F.lit(86400 * 1_000_000)).cast("bigint").alias("span_days"),
    )


def column_notes(profile: DataFrame, stats: DataFrame | None = None, cats: DataFrame | None = None) -> DataFrame:
    """R9 warnings as codes: mostly_empty, partly_empty, constant, negatives,
    skewed, single_group. ``stats``/``cats`` are numeric_stats/category_stats."""
    p = profile.select("column_name", "role", "missing_count", "n_rows")
    if stats is not None:
        p = p.join(stats.select("column_name", "negatives", "skew"), "column_name", "left")
    else:
        p = p.withColumn("negatives", F.lit(None).cast("bigint")).withColumn("skew", F.lit(None).cast("double"))
    if cats is not None:
        p = p.join(cats.select("column_name", "top_share").distinct(), "column_name", "left")
    else:
        p = p.withColumn("top_share", F.lit(None).cast("double"))
    rate = F.col("missing_count") / F.col("n_rows")
    signed = F.lit(False)
    for word in SIGNED_MEASURE_WORDS:
        signed = signed | F.lower(F.col("column_name")).contains(word)
    measure = F.col("role") == "measure"
    notes = F.array_compact(F.array(
        F.when(rate >= 0.5, "mostly_empty").when(rate >= 0.1, "partly_empty"),
        F.when(F.col("role") == "constant", "constant"),
        F.when(measure & (F.coalesce(F.col("negatives"), F.lit(0)) > 0) & ~signed, "negatives"),
        F.when(measure & (F.abs(F.coalesce(F.col("skew"), F.lit(0.0))) > 2), "skewed"),
        F.when((F.col("role") == "category") & (F.coalesce(F.col("top_share"), F.lit(0.0)) > 0.9), "single_group"),
    ))
    return p.select("column_name", F.array_join(notes, "; ").alias("notes"))


def profile_dataset(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """One row per column with role, missing, distinct (lazy)."""
    return profile_rows(column_facts(df), roles)


def profile_rows(facts: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """The profile of a table from the facts of its columns."""
    prof = detect_roles(facts, roles, facts)
    return prof.select(
        "position", "column_name", "dtype", "role", "n_rows", "missing_count",
        F.round(F.col("missing_count") / F.col("n_rows"), 4).alias("missing_rate"),
        "unique_count", "avg_length",
    )


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Whole-row duplicates beyond the first copy (nulls equal)."""
    from veritable.operators.duplicates import find_duplicates

    return find_duplicates(df).select(F.col("extra_copies").alias("duplicate_rows"))


def completeness(df: DataFrame, worst: int = 8) -> DataFrame:
    """Columns with blanks and their % empty (1 dp), worst first."""
    names = df.columns
    wide = df.agg(*[F.avg(F.col(n).isNull().cast("double")).alias(f"m{i}") for i, n in enumerate(names)])
    rows = [F.struct(F.lit(n).alias("column_name"), F.col(f"m{i}").alias("share")) for i, n in enumerate(names)]
    long = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*").filter(F.col("share") > 0)
    return long.orderBy(F.col("share").desc(), F.col("column_name")).limit(worst).select(
        "column_name", F.round(F.col("share") * 100, 1).alias("pct_empty")
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """Row, column and duplicate counts as one row."""
    return duplicate_row_count(df).select(
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        "duplicate_rows",
    ).select("*", *scalar_columns(df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))))


class ProfileCache:
    """Rebuild a profile only when the table changed (``profile_state.ProfileState`` keeps one over a folder's files).

    Looked up by the DataFrame's semantic plan hash and the names, sizes and
    times of the files that it reads, and then confirmed with
    ``sameSemantics``, so that two plans with one hash stay apart. Keeps the
    ``size`` profiles used last.
    """

    def __init__(self, size: int = 32):
        self._store: dict[tuple, tuple[DataFrame, list[dict]]] = {}
        self._size = size

    def rows(self, df: DataFrame, roles: dict[str, str] | None = None) -> list[dict]:
        asked = (df.semanticHash(), tuple(sorted((roles or {}).items())), _files_now(df))
        for key, (known, rows) in list(self._store.items()):
            if key[:3] == asked and known.sameSemantics(df):
                self._store[key] = self._store.pop(key)  # used last
                return rows
        rows = [r.asDict() for r in profile_dataset(df, roles).collect()]  # one row per column
        self._store[(*asked, id(df))] = (df, rows)
        while len(self._store) > self._size:
            self._store.pop(next(iter(self._store)))
        return rows

    def __len__(self) -> int:
        return len(self._store)


def _files_now(df: DataFrame) -> int | None:
    """A checksum of the files that a table reads, from their listing."""
    files = df.inputFiles()
    if not files:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(files)
    mark = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return int(listed.agg(F.sum(mark.cast("decimal(38,0)"))).first()[0] or 0)
