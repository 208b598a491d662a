"""Return files in XML, read once for all schedules.

Sections may sit at any depth, and two of them name the kind of income by the
tag around the line. The layout of the files, that is the tree of their tags, is
learned first (or passed in); it yields one reading schema of text columns for
the sections the model knows, and one scan then gives a row per return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscolake.functions import scalars as S
from fiscolake.functions.files import file_name, file_path
from fiscolake.schemas import CORRUPT, SCHEDULES, xml_line_schema

ROOT_TAG = "declaracao"
_IDENT, _DATE, _VERSION = "identificadorDeclaracao", "dataDeclaracao", "_versao"
READ_OPTIONS = {"inferSchema": "false", "ignoreNamespace": "true", "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": CORRUPT}

Path = tuple[str, ...]


def learn_layout(spark: SparkSession, path: str | list[str], root_tag: str = ROOT_TAG, pattern: str = "*") -> T.StructType:
    """Tag tree of the files, by one distributed pass over all of them."""
    return (spark.read.format("xml").options(**READ_OPTIONS).option("rowTag", root_tag)
            .option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).schema)


def _element(t: T.DataType) -> T.DataType:
    return t.elementType if isinstance(t, T.ArrayType) else t


def _walk(t: T.DataType, at: Path = ()):
    inner = _element(t)
    if at:
        yield at
    if isinstance(inner, T.StructType):
        for f in inner.fields:
            if not f.name.startswith("_"):
                yield from _walk(f.dataType, (*at, f.name))


def _table_of(path: Path) -> str | None:
    """Schedule whose lines stand at this path."""
    if len(path) < 2 or path[-1] != "item":
        return None
    parent, above = path[-2], path[:-2]
    fixed = {"bens": "bens_direitos", "pagamentos": "pagamentos_efetuados",
             "doacoes": "doacoes_efetuadas", "colecaoRendPJTitular": "rendimentos_tributaveis_pj",
             "colecaoRendPJDependente": "rendimentos_tributaveis_pj"}
    if parent in fixed:
        return fixed[parent]
    if "rendIsentos" in above and parent.endswith("QuadroAuxiliar"):
        return "rendimentos_isentos"
    if "rendTributacaoExclusiva" in (*above, parent):
        return "rendimentos_exclusivos"
    return None


def _wanted(layout: T.StructType) -> dict[Path, T.DataType]:
    """Paths to read, each with the type it is read as."""
    out: dict[Path, T.DataType] = {}
    for path in _walk(layout):
        table = _table_of(path)
        if table:
            out[path] = T.ArrayType(xml_line_schema(table))
        elif path[-1] == _IDENT:
            out[path] = T.StructType([T.StructField(n, T.StringType()) for n in ("_cpf", "_nome")])
        elif path[-1] == _DATE:
            out[path] = T.StructType([T.StructField("_VALUE", T.StringType())])
    return out


def _pruned(t: T.DataType, wanted: dict[Path, T.DataType], at: Path = ()) -> T.DataType:
    if at in wanted:
        leaf = wanted[at]
        several = isinstance(t, T.ArrayType) and not isinstance(leaf, T.ArrayType)
        return T.ArrayType(leaf) if several else leaf
    fields = []
    for f in _element(t).fields:
        path = (*at, f.name)
        if any(w[:len(path)] == path for w in wanted):
            fields.append(T.StructField(f.name, _pruned(f.dataType, wanted, path)))
    struct = T.StructType(fields)
    return T.ArrayType(struct) if isinstance(t, T.ArrayType) else struct


def reading_schema(layout: T.StructType) -> T.StructType:
    """The part of the layout the model needs, every value as text."""
    wanted = _wanted(layout)
    schema = _pruned(layout, wanted) if wanted else T.StructType()
    return T.StructType([*schema.fields, T.StructField(_VERSION, T.StringType()),
                         T.StructField(CORRUPT, T.StringType())])


def parse_error(root: Column | None = None) -> Column:
    """Text of an unreadable return, null for a readable one. Spark refuses to
    scan for this text alone, so it is tied to an attribute of the root."""
    text, version = (root[CORRUPT], root[_VERSION]) if root is not None else (F.col(CORRUPT), F.col(_VERSION))
    return F.nullif(F.concat_ws("", text, F.substring(version, 1, 0)), F.lit("")).alias("parse_error")


def _reach(c: Column, t: T.DataType, path: Path) -> Column:
    """Array of the elements at ``path`` below ``c``, through repeated wrappers too."""
    if not path:
        found = c if isinstance(t, T.ArrayType) else F.array(c)
        return F.array_compact(F.coalesce(found, F.array().cast(T.ArrayType(_element(t)))))
    if isinstance(t, T.ArrayType):
        present = F.array_compact(F.coalesce(c, F.array().cast(t)))
        return F.flatten(F.transform(present, lambda x: _reach(x, t.elementType, path)))
    return _reach(c[path[0]], t[path[0]].dataType, path[1:])


def _raw_lines(schema: T.StructType, root: Column | None, table: str) -> Column:
    """All raw lines of a schedule in one array, each with the tag around it."""
    line = xml_line_schema(table)

    def tagged(lines: Column, tag: str) -> Column:
        return F.transform(lines, lambda x: F.struct(
            F.lit(tag).alias("_kind"), *[x[n].alias(n) for n in line.fieldNames()]))

    found = []
    for path in _wanted(schema):
        if _table_of(path) == table:
            start = root[path[0]] if root is not None else F.col(path[0])
            found.append(tagged(_reach(start, schema[path[0]].dataType, path[1:]), path[-2]))
    if not found:
        kind = T.StructField("_kind", T.StringType())
        return F.array().cast(T.ArrayType(T.StructType([kind, *line.fields])))
    return F.concat(*found)


def _first_text(schema: T.StructType, root: Column | None, tag: str, attribute: str) -> Column:
    found = []
    for path in _wanted(schema):
        if path[-1] == tag:
            start = root[path[0]] if root is not None else F.col(path[0])
            values = _reach(start, schema[path[0]].dataType, path[1:])
            found.append(F.get(values, F.lit(0))[attribute])
    return F.coalesce(*found, F.lit(None).cast("string"))


def raw_columns(schema: T.StructType, as_of: Column, root: Column | None = None) -> list[Column]:
    """Key, date, summary and the six arrays of raw lines of a parsed return."""
    cpf = _first_text(schema, root, _IDENT, "_cpf")
    name = _first_text(schema, root, _IDENT, "_nome")
    date = _first_text(schema, root, _DATE, "_VALUE")
    return [cpf.alias("cpf"), S.document_date(date, as_of).alias("data_documento"),
            S.summary_sentence(name, cpf).alias("summary"),
            *[_raw_lines(schema, root, t).alias(t) for t in SCHEDULES]]


def read_xml_returns(spark: SparkSession, path: str | list[str], *, as_of: str,
                     key: Column | None = None, layout: T.StructType | None = None,
                     root_tag: str = ROOT_TAG, once: bool = True, pattern: str = "*") -> DataFrame:
    """One row per return: key, file, date, summary, six arrays of raw lines.

    ``key`` may use ``file_path`` and ``cpf``; by default it is a digest of the
    path and the return, and a return repeated in a file comes out once (unless ``once`` is false). ``as_of`` (a date)
    stands in for a missing document date. Unreadable files come out with ``parse_error`` set and no lines.
    """
    schema = reading_schema(layout or learn_layout(spark, path, root_tag, pattern))
    files = (spark.read.format("xml").options(**READ_OPTIONS).option("rowTag", root_tag).option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).schema(schema).load(path))
    rows = files.select(file_path(), file_name(), file_path().alias("source_path"),
                        *raw_columns(schema, F.lit(as_of).cast("date")),
                        parse_error())
    returns = keyed(rows, key)
    return returns.dropDuplicates(["declaration_id"]) if key is None and once else returns


def keyed(rows: DataFrame, key: Column | None) -> DataFrame:
    """Rows under the caller's key, or a digest of the path and the return, with the ``digest`` of the return."""
    content = F.xxhash64(*[c for c in rows.columns if c not in ("file_path", "file_name", "source_path")]).cast("string")
    own = F.sha2(F.concat_ws("#", "file_path", content), 256)
    return rows.select((own if key is None else key).alias("declaration_id"), "*", content.alias("digest"))


def parse_xml_column(df: DataFrame, text: str, *, as_of: str, layout: T.StructType) -> DataFrame:
    """The same arrays for returns held as XML text in a column."""
    schema = reading_schema(layout)
    parsed = df.withColumn("_return", F.from_xml(F.col(text), schema, {
        "ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    kept = [c for c in df.columns if c != text]
    root = F.col("_return")
    return parsed.select(*kept, *raw_columns(schema, F.lit(as_of).cast("date"), root),
                         parse_error(root))
