"""Nested returns to flat tables and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscolake.functions import scalars as S
from fiscolake.operators import lines as L
from fiscolake.schemas import CORRUPT, DECLARATIONS, MONEY, SCHEDULES, json_schema
from fiscolake.session import written_table

KEY = "declaration_id"
NO_FIELD = "no field of a return"


def _aliased(cols: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in cols.items()]


def _xml_getter(line: Column):
    return lambda name: line["_" + name]


def _json_getter(line: Column):
    return lambda name: line[name]


def _line(table: str, line: Column, source: str) -> dict[str, Column]:
    if source == "xml":
        return L.from_xml(table, _xml_getter(line))
    return L.from_json(table, _json_getter(line))


def _raw(table: str, line: Column, source: str) -> Column:
    """Text the checked columns came from, under the names of these columns."""
    if source == "xml":
        return F.struct(*[S.first_nonempty(*[line["_" + a] for a in names.split()]).alias(c)
                          for c, names in L.XML_RAW[table].items()])
    return F.struct(*[L.json_raw(table, n, _json_getter(line)).alias(n)
                      for n in SCHEDULES[table].fieldNames()])


def schedule_lines(returns: DataFrame, table: str, source: str, *, with_raw: bool = False) -> DataFrame:
    """Flat typed table of one schedule, every line with the key of its return.

    ``source`` is ``xml`` or ``json`` and says how the raw lines are named.
    """
    rows = returns.select(KEY, F.explode_outer(table).alias("_line")).where("_line IS NOT NULL")
    line = F.col("_line")
    extra = [_raw(table, line, source).alias("_raw")] if with_raw else []
    return rows.select(KEY, *_aliased(_line(table, line, source)), *extra)


def declarations_of(returns: DataFrame) -> DataFrame:
    """One row per return: key, file and summary."""
    return returns.select(KEY, F.coalesce("file_path", F.lit("")).alias("file_path"),
                          F.coalesce("file_name", F.lit("")).alias("file_name"),
                          F.coalesce("summary", F.lit("")).alias("summary"))


def shred(returns: DataFrame, source: str) -> dict[str, DataFrame]:
    """All seven flat tables of a set of returns."""
    out = {DECLARATIONS: declarations_of(returns)}
    out.update({t: schedule_lines(returns, t, source) for t in SCHEDULES})
    return out


def typed_returns(returns: DataFrame, source: str) -> DataFrame:
    """Whole returns with typed lines, one row each; lines never leave their row."""
    def typed(table: str) -> Column:
        given = F.coalesce(table, F.array().cast(returns.schema[table].dataType))
        return F.transform(given, lambda x: F.struct(*_aliased(_line(table, x, source))))

    arrays = [typed(t).alias(t) for t in SCHEDULES]
    kept = [c for c in (KEY, "file_path", "file_name", "parse_error") if c in returns.columns]
    return returns.select(*kept, *arrays, "data_documento",
                          F.struct(F.col("summary").alias("text")).alias("summary"))


def json_returns(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Nested returns read under the JSON schema, with key, file, date and summary.

    A file may hold many returns, so the default key is a digest of the file (``source_path`` where there is one, else
    ``file_path``) and the record; a record repeated word for word in one file is one return. Where the text of broken
    records was read too, ``parse_error`` tells what is wrong with a record: its text, or that no field of a return is in it.
    """
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("file_path", "file_name")]
    columns += [F.col(c) for c in ("source_path",) if c in df.columns]
    digest = F.col("digest") if "digest" in df.columns else json_digest()
    own = F.sha2(F.concat_ws("#", "source_path" if "source_path" in df.columns else "file_path", digest), 256)
    if CORRUPT in df.columns:
        fields = [*SCHEDULES, "data_documento", "summary"]
        foreign = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in fields])
        columns.append(F.coalesce(CORRUPT, F.when(foreign, NO_FIELD)).alias("parse_error"))
        columns.append(digest.alias("digest"))
    return df.select((own if key is None else key).alias(KEY), *columns,
                     F.expr("try_cast(data_documento AS date)").alias("data_documento"),
                     S.summary_text(F.col("summary")).alias("summary"), *SCHEDULES)


def json_digest() -> Column:
    """Digest of a record as read."""
    return F.xxhash64(*json_schema().fieldNames()).cast("string")


def parse_json_column(df: DataFrame, text: str, key: Column | None = None) -> DataFrame:
    """Nested returns held as JSON text in a column."""
    parsed = df.withColumn("_return", F.from_json(text, json_schema(), {"mode": "PERMISSIVE"}))
    kept = [c for c in df.columns if c not in (text, "file_path", "file_name")]
    return json_returns(parsed.select(*kept, "_return.*"), key)


# ---------------------------------------------------------------- assembling

def _page_counts(tables: dict[str, DataFrame], max_lines: int) -> DataFrame:
    """Returns with more than ``max_lines`` lines in a schedule, and the number of
    pages each needs. Counting combines before the shuffle; the result, at most
    one row per ``max_lines`` lines, is written down."""
    keys = [tables[n].select(KEY, F.lit(n).alias("_table")) for n in SCHEDULES]
    counted = (reduce(DataFrame.unionByName, keys).groupBy("_table", KEY)
               .agg(F.ceil(F.count("*") / max_lines).cast("int").alias("_pages")))
    return written_table(counted.where("_pages > 1"), "pages")


def assemble(tables: dict[str, DataFrame], *, data_documento: Column, max_lines: int = 100_000) -> DataFrame:
    """Flat tables back to nested returns, one row per return and page.

    Nearly every return has the single page 0. One with more than ``max_lines``
    lines in a schedule is cut into pages instead of being gathered in one row:
    the page of a line is drawn from a digest of the line, and together the
    pages hold all lines. All schedules and the returns' own data share one
    shuffle. ``data_documento`` is computed from the table of returns.
    """
    large = _page_counts(tables, max_lines)
    paged = not large.isEmpty()

    def lines_of(name: str) -> DataFrame:
        lines = tables[name].select(KEY, *SCHEDULES[name].fieldNames())
        page = F.lit(0)
        if paged:
            pages = large.where(F.col("_table") == name).select(KEY, "_pages")
            digest = F.xxhash64(KEY, *SCHEDULES[name].fieldNames())
            lines = lines.join(pages, KEY, "left")
            page = F.coalesce(F.pmod(digest, F.col("_pages")).cast("int"), F.lit(0))
        return lines.select(KEY, page.alias("page"), F.struct(*SCHEDULES[name].fieldNames()).alias(name))

    own = F.struct("file_path", "file_name", data_documento.alias("data_documento"),
                   F.struct(F.coalesce("summary", F.lit("")).alias("text")).alias("summary"))
    returns = tables[DECLARATIONS].select(KEY, own.alias("_own"))
    if paged:
        most = large.groupBy(KEY).agg(F.max("_pages").alias("_pages"))
        every = F.explode(F.sequence(F.lit(0), F.coalesce("_pages", F.lit(1)) - 1))
        returns = returns.join(most, KEY, "left").select(KEY, every.alias("page"), "_own")
    else:
        returns = returns.withColumn("page", F.lit(0))

    parts = [returns, *[lines_of(n) for n in SCHEDULES]]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # Nulls stay out of the lists; lines without a return drop with their group.
    grouped = union.groupBy(KEY, "page").agg(F.any_value("_own", ignoreNulls=True).alias("_own"),
                                             *[F.collect_list(n).alias(n) for n in SCHEDULES])
    return (grouped.where("_own IS NOT NULL")
            .select(KEY, "page", "_own.file_path", "_own.file_name", *SCHEDULES,
                    "_own.data_documento", "_own.summary"))


def flatten_returns(typed: DataFrame) -> dict[str, DataFrame]:
    """Typed nested returns to the seven flat tables."""
    out = {DECLARATIONS: typed.select(
        KEY, F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce("file_name", F.lit("")).alias("file_name"),
        F.coalesce("summary.text", F.lit("")).alias("summary")).dropDuplicates([KEY])}
    out.update({t: typed.select(KEY, F.inline(t)) for t in SCHEDULES})
    return out


def money_as_double(df: DataFrame) -> DataFrame:
    """Flat or nested money as floating point, for users who want it."""
    def cast(t):
        text = t.simpleString()
        plain = text.replace(MONEY.simpleString(), "double")
        return None if plain == text else plain
    return df.select(*[F.col(f.name).cast(cast(f.dataType)).alias(f.name) if cast(f.dataType)
                       else F.col(f.name) for f in df.schema.fields])


def return_json(typed: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Returns as JSON text: money as text, ISO dates, nulls and accents kept. The text lacks the schedules ``without``."""
    def text_money(table: str) -> Column:
        return F.transform(table, lambda x: F.struct(*[
            (x[f.name].cast("string") if f.dataType == MONEY else x[f.name]).alias(f.name)
            for f in SCHEDULES[table].fields])).alias(table)
    document = F.struct(*[text_money(t) for t in SCHEDULES if t not in without], "data_documento", "summary")
    kept = [c for c in (KEY, "page", "file_path", "file_name", "parse_error") if c in typed.columns]
    return typed.select(*kept, F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def dense_ids(declarations: DataFrame, order: str = "file_path") -> DataFrame:
    """Replace the key by 0, 1, 2 … in the order of ``order``.

    Rows are range partitioned and written down; each partition is then
    numbered on its own, on top of the sizes of the partitions before it.
    """
    ranged = written_table(
        declarations.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ids")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    # One row per partition of the step above.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(order, KEY)) - 1
    return (ranged.join(offsets, "_part").withColumn(KEY, F.col("_offset") + number)
            .drop("_part", "_offset"))
