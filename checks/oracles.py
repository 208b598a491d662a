"""For every registered query the same result in plain SQL over the given tables."""

from __future__ import annotations

from html.entities import name2codepoint

from checks.bridge import AS_OF, SQL_TABLES, sql_with
from fiscolake.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE
from fiscolake.operators.embed import DIMENSION
from fiscolake.plans.analytics import NO_INCOME_MESSAGE  # noqa: F401  (documents the guard's text)
from fiscolake.schemas import INCOME_TABLES, SCHEDULES

_INCOME = sql_with(*INCOME_TABLES)


def _income_rows(label: str, drop_null: bool) -> str:
    keep = " WHERE nome_fonte_pagadora IS NOT NULL" if drop_null else ""
    return f"""SELECT '{label}' AS tipo, nome_fonte_pagadora AS fonte, rendimentos AS valor
        FROM rendimentos_tributaveis_pj
        UNION ALL SELECT 'Exclusivo', nome_fonte_pagadora, valor FROM rendimentos_exclusivos
        UNION ALL SELECT 'Isento', nome_fonte_pagadora, valor FROM rendimentos_isentos{keep}"""


_SOURCES = _INCOME + f"""SELECT tipo, fonte, CAST(valor AS DOUBLE) AS valor
    FROM ({_income_rows('Tributável PJ', True)}) ORDER BY valor DESC"""


def _payments(total: str) -> str:
    return sql_with("pagamentos_efetuados") + f"""SELECT codigo, CAST(SUM(valor_pago) AS DOUBLE) AS {total}
        FROM pagamentos_efetuados GROUP BY codigo ORDER BY {total} DESC"""


def _br(expr: str) -> str:
    return f"translate(format('{{:,.2f}}', CAST({expr} AS DOUBLE)), ',.', '.,')"


def _report_row(table: str) -> str:
    columns = {"rendimentos_tributaveis_pj": "declaration_id, cpf_cnpj_fonte_pagadora"}.get(
        table, "declaration_id, tipo_rendimento")
    return f"""SELECT '{table}' AS table_name, true AS table_exists,
        (SELECT count(*) FROM {table}) AS n_rows, 'filled' AS status,
        (SELECT string_agg(CAST(declaration_id AS VARCHAR), ',' ORDER BY declaration_id) FROM
         (SELECT declaration_id FROM {table} ORDER BY {columns} LIMIT 3)) AS sample_keys"""


def _orphans(table: str) -> str:
    return f"""SELECT declaration_id, count(*) AS n_rows, '{table}' AS table_name FROM {table}
        WHERE declaration_id NOT IN (SELECT declaration_id FROM declarations) GROUP BY declaration_id"""


def _typed(table: str, where: str = "") -> str:
    """Flat table as a query returns it, money as floating point."""
    cols = [f"CAST({f.name} AS DOUBLE) AS {f.name}" if f.dataType.typeName() == "decimal" else f.name
            for f in SCHEDULES[table].fields]
    return sql_with("declarations", table) + f"""SELECT declaration_id, {', '.join(cols)} FROM {table}
        WHERE declaration_id IN (SELECT declaration_id FROM declarations){where}"""


_PICKED = {"bens_direitos": ("discriminacao", "valor_2024"), "doacoes_efetuadas": ("nome_proponente", "valor_pago"),
           "pagamentos_efetuados": ("codigo", "valor_pago"), "rendimentos_exclusivos": ("nome_fonte_pagadora", "valor"),
           "rendimentos_isentos": ("nome_fonte_pagadora", "valor"),
           "rendimentos_tributaveis_pj": ("nome_fonte_pagadora", "rendimentos")}
_LABEL_AMOUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, declaration_id, {a} AS label, CAST({b} AS DOUBLE) AS amount FROM {n}"
    for n, (a, b) in _PICKED.items())
_ALL = sql_with(*SQL_TABLES)
_HAS_RETURN = "declaration_id IN (SELECT declaration_id FROM declarations)"
_DATE = "CAST(DATE '2025-01-01' + CAST(declaration_id % 100 AS INTEGER) AS DATE)"

_VALIDATE = sql_with("declarations", "pagamentos_efetuados", "rendimentos_exclusivos",
                     "rendimentos_tributaveis_pj") + f"""
SELECT declaration_id, 'pagamentos_efetuados' AS table_name, 'valor_pago' AS column_name, 'money' AS rule,
    {_br('valor_pago')} || '5' AS raw_value FROM pagamentos_efetuados
    WHERE CAST(cpf_cnpj_prestador AS BIGINT) % 7 = 0
UNION ALL SELECT declaration_id, 'pagamentos_efetuados', 'cpf_beneficiario', 'length', substr(cpf_beneficiario, 1, 5)
    FROM pagamentos_efetuados WHERE declaration_id % 9 = 0
UNION ALL SELECT declaration_id, 'rendimentos_exclusivos', 'cnpj_fonte_pagadora', 'required', CAST(NULL AS VARCHAR)
    FROM rendimentos_exclusivos WHERE CAST(cnpj_fonte_pagadora AS BIGINT) % 5 = 0
UNION ALL SELECT declaration_id, 'rendimentos_tributaveis_pj', 'nome_fonte_pagadora', 'required', NULL
    FROM rendimentos_tributaveis_pj WHERE CAST(cpf_cnpj_fonte_pagadora AS BIGINT) % 8 = 0
UNION ALL SELECT declaration_id, 'rendimentos_tributaveis_pj', 'rendimentos', 'money', 'abc'
    FROM rendimentos_tributaveis_pj WHERE CAST(cpf_cnpj_fonte_pagadora AS BIGINT) % 25 = 0
UNION ALL SELECT declaration_id, 'declarations', 'summary', 'not_empty', '' FROM declarations
    WHERE declaration_id % 6 = 0"""

# ---------------------------------------------------------------- retrieval

_TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _terms(expr: str) -> str:
    return _TERMS.format(expr)


def _words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


def _word_chunks(docs: str) -> str:
    step = CHUNK_SIZE - CHUNK_OVERLAP
    return f"""w AS (SELECT doc_id, {_words('text')} AS ws FROM {docs}),
    parts AS (SELECT doc_id, ws, CAST(unnest(range(0, 1 + CAST(ceil(greatest(len(ws) - {CHUNK_SIZE}, 0) / {step}) AS BIGINT)))
              AS INTEGER) AS chunk_no FROM w WHERE len(ws) > 0),
    chunks AS (SELECT doc_id, chunk_no, list_slice(ws, chunk_no * {step} + 1, chunk_no * {step} + {CHUNK_SIZE}) AS cw FROM parts)"""


_CHUNK_VIEW = """SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(chunk_no AS INTEGER) AS chunk_no,
    CAST(len(cw) AS INTEGER) AS n_tokens, md5(array_to_string(cw, ' ')) AS text_md5 FROM chunks"""

_SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"

# Chunks of a document one after the other: each begins at piece `f` and ends
# before piece `e`; `s` holds running word counts.
_SENTENCE_CHUNKS = f"""
    sents AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{_SENTENCE}'),
        lambda x: {_words('x')}), lambda x: len(x) > 0) AS ss FROM documents),
    pieces AS (SELECT doc_id, flatten(list_transform(ss, lambda x: list_transform(
        range(0, 1 + (len(x) - 1) // {CHUNK_SIZE}), lambda i: list_slice(x, i * {CHUNK_SIZE} + 1, (i + 1) * {CHUNK_SIZE})))) AS ps
        FROM sents WHERE len(ss) > 0),
    flat AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(list_transform(ps, lambda p: len(p))) AS n FROM pieces),
    sums AS (SELECT doc_id, list(t ORDER BY i) AS s FROM (
        SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM flat) GROUP BY doc_id),
    total AS (SELECT doc_id, list_prepend(0, s) AS s FROM sums),
    -- Chunk [f, e) of pieces counted from 0: e is the last end that fits.
    rec AS (
        SELECT doc_id, 0 AS chunk_no, 0 AS f, s,
            greatest(1, len(list_filter(s, lambda x: x <= {CHUNK_SIZE})) - 1) AS e FROM total
        UNION ALL
        SELECT doc_id, chunk_no + 1, g, s,
            greatest(g + 1, len(list_filter(s, lambda x: x <= s[g + 1] + {CHUNK_SIZE})) - 1)
        FROM (SELECT doc_id, chunk_no, s, greatest(f + 1, least(e,
                  len(list_filter(s, lambda x: x < s[e + 1] - least({CHUNK_OVERLAP}, {CHUNK_SIZE} - (s[e + 2] - s[e + 1])))))) AS g
              FROM rec WHERE e < len(s) - 1)),
    chunks AS (SELECT r.doc_id, r.chunk_no, flatten(list_slice(p.ps, r.f + 1, r.e)) AS cw
               FROM rec r JOIN pieces p USING (doc_id))"""


def _slots(name: str, source: str, key: str, text: str) -> str:
    """Unit-length hashed word counts, one row per slot in use."""
    return f"""{name}_t AS (SELECT {key} AS id, unnest({_terms(text)}) AS t FROM {source}),
    {name}_c AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIMENSION} AS slot, count(*) AS c
                 FROM {name}_t GROUP BY ALL),
    {name}_n AS (SELECT id, sqrt(sum(c * c)) AS norm FROM {name}_c GROUP BY id),
    {name} AS (SELECT id, slot, CAST(CAST(c / norm AS FLOAT) AS DOUBLE) AS v FROM {name}_c JOIN {name}_n USING (id))"""


def _top(scores: str, k: int = 2) -> str:
    return f"""SELECT * FROM (SELECT query_id, item_id, score, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM ({scores})) WHERE rank <= {k}"""


_ANY_SCORE = """SELECT a.id AS query_id, b.id AS item_id, round(coalesce(max(s.score), 0), 6) AS score
    FROM (SELECT DISTINCT id FROM {q}) a CROSS JOIN ({items}) b
    LEFT JOIN (SELECT q.id AS qid, d.id AS did, sum(q.v * d.v) AS score FROM {q} q JOIN {d} d USING (slot)
               GROUP BY ALL) s ON s.qid = a.id AND s.did = b.id GROUP BY ALL"""

_BM25 = f"""dt AS (SELECT doc_id, unnest({_terms('text')}) AS t FROM documents),
    dl AS (SELECT doc_id, len({_terms('text')}) AS n FROM documents),
    st AS (SELECT count(*) AS n_docs, avg(n) AS mean FROM dl),
    tf AS (SELECT doc_id, t, count(*) AS tf FROM dt GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    qt AS (SELECT item_id AS query_id, unnest({_terms('text')}) AS t FROM benchmark),
    bm AS (SELECT query_id, tf.doc_id AS item_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5))
           * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / mean))), 6) AS score
           FROM qt JOIN tf USING (t) JOIN df USING (t) JOIN dl USING (doc_id) CROSS JOIN st
           GROUP BY query_id, tf.doc_id)"""

_QUESTIONS = _slots("qv", "benchmark", "item_id", "text")
_DOCS = _slots("dv", "documents", "doc_id", "text")

# ---------------------------------------------------------------- pages

_SPACE = r"[ \t\n\r\f\x{00a0}]"
_MARK = "chr(1)"


def _plain_text(markup: str) -> str:
    named = "MAP {" + ", ".join(f"'{n}': chr({c})" for n, c in name2codepoint.items()) + "}"
    tagless = f"regexp_replace({markup}, '<[a-zA-Z/!?][^>]*>', {_MARK}, 'g')"
    return _collapse(_entities(tagless, named))


def _entities(expr: str, named: str) -> str:
    ref = "'^([a-zA-Z][a-zA-Z0-9]*);?'"
    piece = f"""CASE WHEN {named}[regexp_extract(p, {ref}, 1)] IS NOT NULL
        THEN {named}[regexp_extract(p, {ref}, 1)] || substr(p, length(regexp_extract(p, {ref}, 0)) + 1)
        ELSE '&' || p END"""
    parts = f"string_split({expr}, '&')"
    return f"""{parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: {piece}), '')"""


def _collapse(expr: str) -> str:
    gap = f"'{_SPACE}*\\x01[ \\t\\n\\r\\f\\x{{00a0}}\\x01]*'"
    joined = f"regexp_replace({expr}, {gap}, ' ', 'g')"
    single = f"regexp_replace({joined}, '[ \\t\\n\\r\\f]+', ' ', 'g')"
    return f"regexp_replace({single}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _code_free(expr: str) -> str:
    for pattern in ("(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script[^>]*>", "(?is)<style[^>]*>.*?</style[^>]*>"):
        expr = f"regexp_replace({expr}, '{pattern}', {_MARK}, 'g')"
    return expr


_NAMED = "MAP {" + ", ".join(f"'{n}': chr({c})" for n, c in name2codepoint.items()) + "}"
_TITLE = f"""nullif(regexp_replace({_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)", _NAMED)},
    '^{_SPACE}+|{_SPACE}+$', '', 'g'), '')"""
_MAIN = r"(?is)<(?:article|main)(?:[ \t\n\r\f][^>]*)?>(.*)</(?:article|main)[ \t\n\r\f]*>"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
_PATHLESS = "regexp_extract(url, '^[^?#]*')"

_SEEN = """seen AS (
        SELECT page_id FROM pages WHERE page_id = 1
        UNION SELECT p.page_id FROM seen s, pages p WHERE p.page_id IN (2 * s.page_id + 1, 2 * s.page_id + 2)
            OR (s.page_id > 2 AND p.page_id = (s.page_id - 1) // 2))"""

_RETURN_TOTALS = (f"""SELECT declaration_id, strftime({_DATE}, '%Y-%m-%d') AS data_documento, summary, """
    + ", ".join(f"""CAST((SELECT count(*) FROM {n} x WHERE x.declaration_id = d.declaration_id) AS BIGINT)
        AS n_{n}""" for n in SCHEDULES)
    + """, coalesce((SELECT CAST(sum(CAST(valor_pago * 100 AS BIGINT)) AS BIGINT) FROM pagamentos_efetuados x
        WHERE x.declaration_id = d.declaration_id), 0) AS paid_cents,
    coalesce((SELECT CAST(sum(CAST(imposto_retido * 100 AS BIGINT)) AS BIGINT) FROM rendimentos_tributaveis_pj x
        WHERE x.declaration_id = d.declaration_id), 0) AS tax_cents,
    CAST((SELECT count(*) FROM rendimentos_isentos x WHERE x.declaration_id = d.declaration_id
        AND nome_fonte_pagadora IS NULL) AS BIGINT) AS n_nameless FROM declarations d""")

ORACLES = {
    "income_sources": _SOURCES,
    "income_sources_guard": _SOURCES,
    "income_sources_grouped": _INCOME + f"""SELECT fonte AS nome_fonte_pagadora, tipo AS tipo_rendimento,
        CAST(SUM(valor) AS DOUBLE) AS total_valor FROM ({_income_rows('Tributável', False)})
        GROUP BY fonte, tipo ORDER BY total_valor DESC""",
    "salary_income": sql_with("declarations", "rendimentos_tributaveis_pj") + """
        SELECT d.file_name, r.nome_fonte_pagadora, CAST(r.rendimentos AS DOUBLE) AS rendimentos
        FROM rendimentos_tributaveis_pj r JOIN declarations d ON r.declaration_id = d.declaration_id
        ORDER BY rendimentos DESC""",
    "payments_by_category": _payments("total_value"),
    "payments_by_category_alt": _payments("total_pago"),
    "asset_stats": sql_with("bens_direitos") + """SELECT grupo, COUNT(*) AS count,
        CAST(SUM(valor_2024) AS DOUBLE) AS total_value_2024, ROUND(AVG(valor_2024), 4) AS avg_value_2024,
        CAST(MIN(valor_2024) AS DOUBLE) AS min_value_2024, CAST(MAX(valor_2024) AS DOUBLE) AS max_value_2024
        FROM bens_direitos GROUP BY grupo ORDER BY total_value_2024 DESC""",
    "asset_change": sql_with("bens_direitos") + """SELECT grupo, COUNT(*) AS num_assets,
        CAST(SUM(valor_2023) AS DOUBLE) AS total_2023, CAST(SUM(valor_2024) AS DOUBLE) AS total_2024,
        CAST(SUM(valor_2024 - valor_2023) AS DOUBLE) AS value_change,
        ROUND(CAST(SUM(valor_2024) - SUM(valor_2023) AS DOUBLE) / NULLIF(CAST(SUM(valor_2023) AS DOUBLE), 0) * 100, 4)
            AS percent_change FROM bens_direitos GROUP BY grupo ORDER BY total_2024 DESC""",
    "free_sql": sql_with("declarations", "pagamentos_efetuados") + """
        SELECT d.file_name, p.codigo, CAST(SUM(p.valor_pago) AS DOUBLE) AS total
        FROM pagamentos_efetuados p JOIN declarations d ON d.declaration_id = p.declaration_id
        GROUP BY p.declaration_id, d.file_name, p.codigo""",
    "table_report": _INCOME + " UNION ALL ".join(_report_row(t) for t in INCOME_TABLES)
        + " UNION ALL SELECT 'tabela_inexistente', false, NULL, 'missing', NULL",
    "parse_money": f"""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(14,2)) AS x,
            {_br('CAST(l_extendedprice AS DECIMAL(14,2))')} AS p FROM lineitem)
        SELECT l_orderkey, l_linenumber,
            CASE WHEN l_orderkey % 11 = 0 THEN p || '7' WHEN l_orderkey % 13 = 0 THEN 'R$' || p
                 WHEN l_orderkey % 17 = 0 THEN '' WHEN l_orderkey % 19 = 0 THEN NULL
                 WHEN l_orderkey % 23 = 0 THEN ' -' || p ELSE p END AS raw,
            CAST(CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 13 = 0 THEN NULL
                 WHEN l_orderkey % 17 = 0 OR l_orderkey % 19 = 0 THEN 0
                 WHEN l_orderkey % 23 = 0 THEN -x ELSE x END AS DOUBLE) AS value FROM r""",
    "only_digits": """SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cpf,
        regexp_replace(c_name, '[^0-9]', '', 'g') AS name_digits FROM customer""",
    "pad_code": """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 120 < 10
        THEN '0' || (p_partkey % 120) ELSE CAST(p_partkey % 120 AS VARCHAR) END AS codigo FROM part""",
    "first_nonempty": """SELECT l_orderkey, l_linenumber, coalesce(
        nullif(CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END, ''),
        CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE l_linestatus END, '00000000000') AS chosen FROM lineitem""",
    "flag_label": """SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 7 THEN 'titular'
        WHEN l_suppkey % 6 = 1 THEN 'dependente' WHEN l_suppkey % 6 IN (2, 3) THEN 'alimentando'
        ELSE 'titular' END AS label FROM lineitem""",
    "doc_date": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0
        THEN DATE '{AS_OF}' ELSE CAST(o_orderdate AS DATE) END AS data_documento FROM orders""",
    "summary_sentence": """SELECT c_custkey, 'Declaração IRPF-2025 de '
        || CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE 'declarante' END || ' (CPF '
        || CASE WHEN c_custkey % 7 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 11, '0') ELSE '???' END
        || ').' AS summary FROM customer""",
    "copy_forward": sql_with("bens_direitos") + """SELECT declaration_id, CAST(CASE
        WHEN declaration_id % 3 = 0 AND declaration_id % 4 IN (0, 1) THEN valor_2023
        WHEN declaration_id % 4 = 0 THEN 0 WHEN declaration_id % 4 = 1 THEN NULL
        WHEN declaration_id % 3 = 0 AND valor_2024 = 0 THEN valor_2023
        ELSE valor_2024 END AS DOUBLE) AS valor_2024 FROM bens_direitos""",
    "local_names": "SELECT p_partkey, p_brand AS tag FROM part",
    "validate_rejects": _VALIDATE,
    "pk_duplicates": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "fk_orphans": _ALL + " UNION ALL ".join(_orphans(t) for t in SCHEDULES),
    "xml_assets": _typed("bens_direitos"),
    "xml_payments": _typed("pagamentos_efetuados").replace(
        "cpf_cnpj_prestador, nome_prestador", "cpf_cnpj_prestador, nome_beneficiario AS nome_prestador"),
    "xml_donations": _typed("doacoes_efetuadas"),
    "xml_salary": _typed("rendimentos_tributaveis_pj"),
    "xml_exempt": _typed("rendimentos_isentos"),
    "xml_exclusive": _typed("rendimentos_exclusivos"),
    "xml_returns": sql_with("declarations", "doacoes_efetuadas") + f"""
        SELECT declaration_id, lpad(CAST(declaration_id AS VARCHAR), 11, '0') AS cpf,
        CASE WHEN declaration_id % 10 <> 0 THEN {_DATE} ELSE DATE '{AS_OF}' END AS data_documento, summary,
        CAST((SELECT count(*) FROM doacoes_efetuadas x WHERE x.declaration_id = d.declaration_id) AS INTEGER)
            AS n_donations FROM declarations d""",
    "json_shred": _ALL + f"SELECT * FROM ({_LABEL_AMOUNTS}) WHERE {_HAS_RETURN}",
    "return_to_json": _ALL + _RETURN_TOTALS,
    "return_documents": _ALL + "SELECT data_documento, summary, " + ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (*[f"n_{n}" for n in SCHEDULES], "paid_cents", "tax_cents", "n_nameless"))
        + f" FROM ({_RETURN_TOTALS}) GROUP BY data_documento, summary",
    "typed_empty_schedule": _ALL + "SELECT " + ", ".join(
        f"count(*) FILTER (table_name = '{n}') AS {n}" for n in SCHEDULES) + f""", round(sum(amount), 2) AS amount
        FROM ({_LABEL_AMOUNTS}) WHERE {_HAS_RETURN} AND table_name NOT IN ('doacoes_efetuadas', 'bens_direitos')""",
    "csv_round_trip": _ALL + f"""SELECT x.*, d.file_name FROM ({_LABEL_AMOUNTS}) x
        LEFT JOIN declarations d USING (declaration_id)""",
    "money_double": sql_with("declarations", "doacoes_efetuadas") + f"""SELECT declaration_id, codigo,
        CAST(valor_pago AS DOUBLE) AS valor_pago FROM doacoes_efetuadas WHERE {_HAS_RETURN}""",
    "dense_ids": sql_with("declarations") + """SELECT row_number() OVER (ORDER BY file_path) - 1 AS declaration_id,
        file_path FROM declarations""",
    "load_xml": _ALL + f"SELECT * FROM ({_LABEL_AMOUNTS}) WHERE {_HAS_RETURN}",
    "load_documents": _ALL + f"SELECT * FROM ({_LABEL_AMOUNTS}) WHERE {_HAS_RETURN}",
    "load_changes": sql_with("declarations", "doacoes_efetuadas", "pagamentos_efetuados") + """SELECT step, keys, table_name, name,
        CAST(sum(copies) AS BIGINT) AS n, CAST(sum(v * copies) AS DOUBLE) AS amount FROM (
          SELECT step, keys, table_name, summary AS name, v,
            CASE WHEN step = 'first' AND keys = 'own' AND declaration_id % 4 = 0 THEN 2 ELSE 1 END AS copies
          FROM (SELECT 'declarations' AS table_name, declaration_id, CAST(NULL AS DECIMAL(14, 2)) AS v FROM declarations
                UNION ALL SELECT 'doacoes_efetuadas', declaration_id, valor_pago FROM doacoes_efetuadas
                UNION ALL SELECT 'pagamentos_efetuados', declaration_id, valor_pago FROM pagamentos_efetuados)
          JOIN (SELECT declaration_id, summary FROM declarations) USING (declaration_id),
            (VALUES ('first'), ('second')) s(step), (VALUES ('own'), ('given')) k(keys)
          WHERE step = 'first' OR NOT (declaration_id % 4 = 1 OR declaration_id % 4 = 2 AND table_name = 'doacoes_efetuadas')
          UNION ALL SELECT step, keys, 'rejects', 'readable', NULL, 2
          FROM (VALUES ('first'), ('second')) s(step), (VALUES ('own'), ('given')) k(keys))
        GROUP BY ALL""",
    "file_changes": """SELECT '/kb/' || source || '/' || d.doc_id || '.txt' AS path,
        CASE WHEN quality IS NULL THEN 'new' ELSE 'modified' END AS change
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL OR quality = 0""",
    "file_status": """SELECT
        CASE WHEN c_acctbal >= 0 THEN 'disponível' ELSE 'indisponível' END AS status, '/in/' || c_name || '.xml' AS arquivo,
        CASE WHEN c_acctbal >= 0 THEN format('{:.2f} KB', c_custkey * 37 / 1024.0::DOUBLE) END AS tamanho,
        CASE WHEN c_acctbal >= 0 THEN 'A declaração está disponível para acesso'
             ELSE 'O arquivo da declaração não foi encontrado' END AS mensagem FROM customer""",
    "stream_arrivals": _typed("pagamentos_efetuados"),
    "chunk_words": "WITH " + _word_chunks("documents") + " " + _CHUNK_VIEW,
    "chunk_sentences": "WITH RECURSIVE " + _SENTENCE_CHUNKS + " " + _CHUNK_VIEW,
    "knowledge_base": "WITH RECURSIVE " + _SENTENCE_CHUNKS.replace(
        "FROM documents", "FROM (SELECT item_id AS doc_id, text FROM benchmark)") + " " + _CHUNK_VIEW,
    "collection_upsert": f"""WITH kept AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'nova versão ' || text
            ELSE text END AS text FROM documents WHERE lang <> 'es'), {_word_chunks('kept')} {_CHUNK_VIEW}""",
    "bm25_topk": "WITH " + _BM25 + _top("SELECT * FROM bm"),
    "vector_topk": "WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, "
        "range(1, 65) r(i) GROUP BY label, i) " + _top("""SELECT m.label AS query_id, vec_id AS item_id,
        round(sum(m.v * CAST(embedding[m.i] AS DOUBLE)), 6) AS score FROM m, embeddings GROUP BY ALL"""),
    "vector_cells": _top("""SELECT q.vec_id AS query_id, e.vec_id AS item_id,
        round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings q, embeddings e WHERE q.vec_id % 10 = 0""", 5),
    "bm25_stored": "WITH " + _BM25 + _top("SELECT * FROM bm"),
    "embed_hashed": f"WITH {_DOCS} SELECT id AS doc_id, CAST(slot AS INTEGER) AS slot, round(v, 5) AS value FROM dv",
    "hybrid_hits": f"WITH {_BM25}, {_QUESTIONS}, {_DOCS} SELECT *, 'vector' AS source FROM ("
        + _top(_ANY_SCORE.format(q="qv", d="dv", items="SELECT doc_id AS id FROM documents"))
        + ") UNION ALL SELECT *, 'bm25' FROM (" + _top("SELECT * FROM bm") + ")",
    "kb_context": f"WITH RECURSIVE {_SENTENCE_CHUNKS}, ct AS (SELECT doc_id, chunk_no, doc_id || '/' || chunk_no AS cid, "
        "sha256(doc_id || '/' || chunk_no) AS chunk_id, array_to_string(cw, ' ') AS text FROM chunks), "
        + _QUESTIONS + ", " + _slots("cv", "ct", "chunk_id", "text")
        + " SELECT h.query_id, h.rank, h.score, CAST(ct.doc_id AS BIGINT) AS doc_id, CAST(ct.chunk_no AS INTEGER) AS chunk_no, "
        "md5(ct.text) AS context_md5 FROM ("
        + _top(_ANY_SCORE.format(q="qv", d="cv", items="SELECT chunk_id AS id FROM ct"))
        + ") h JOIN ct ON ct.chunk_id = h.item_id",
    "page_links": f"""WITH l AS (SELECT url, unnest(regexp_extract_all({_code_free('html')}, '<a href="([^"]*)"', 1)) AS h
            FROM pages)
        SELECT url AS src_url, {_ROOT} || regexp_extract(replace(h, '&amp;', '&'), '^[^#]*') AS dst_url FROM l
        WHERE {_HOST} LIKE '%example.com'""",
    "page_record": f"""SELECT url, {_TITLE} AS title, CAST(NULL AS VARCHAR) AS description,
        {_plain_text(_code_free('html'))} AS text FROM pages""",
    "page_main_text": f"""WITH c AS (SELECT url, html, {_code_free('html')} AS m FROM pages),
        b AS (SELECT url, html, CASE WHEN regexp_matches(m, '{_MAIN}') THEN regexp_extract(m, '{_MAIN}', 1) ELSE m END AS m FROM c)
        SELECT * FROM (SELECT url, {_HOST} AS host, {_TITLE} AS title, CAST(NULL AS VARCHAR) AS description,
        {_plain_text('m')} AS text FROM b) WHERE text <> ''""",
    "scraped_json": f"""WITH c AS (SELECT url, html, {_code_free('html')} AS m FROM pages),
        b AS (SELECT url, html, CASE WHEN regexp_matches(m, '{_MAIN}') THEN regexp_extract(m, '{_MAIN}', 1) ELSE m END AS m FROM c)
        SELECT url, title, md5(text) AS text_md5 FROM (SELECT url, {_TITLE} AS title, {_plain_text('m')} AS text FROM b)
        WHERE text <> ''""",
    "url_forms": f"""WITH p AS (SELECT url, {_ROOT} AS root, {_HOST} AS host, {_PATHLESS} AS pathless,
            regexp_extract({_PATHLESS}, '^.*/') AS folder, regexp_extract(url, '^[a-z]+:') AS scheme FROM pages),
        f AS (
        SELECT url, '../up' AS href, CASE WHEN folder = root || '/' THEN root || '/up'
            ELSE regexp_replace(folder, '[^/]*/$', '') || 'up' END AS resolved, host FROM p
        UNION ALL SELECT url, 'x/./y', folder || 'x/y', host FROM p
        UNION ALL SELECT url, '/root', root || '/root', host FROM p
        UNION ALL SELECT url, '//other.example:80/z', scheme || '//other.example:80/z', 'other.example:80' FROM p
        UNION ALL SELECT url, '?q=1', pathless || '?q=1', host FROM p
        UNION ALL SELECT url, '#frag', regexp_extract(url, '^[^#]*') || '#frag', host FROM p
        UNION ALL SELECT url, 'mailto:a@b.example', 'mailto:a@b.example', '' FROM p
        UNION ALL SELECT url, '', url, host FROM p)
        SELECT url, href, resolved, host, regexp_extract(url, '^[^#]*') AS page FROM f""",
    "page_reachable": f"""WITH RECURSIVE {_SEEN}
        SELECT 'https://site.example/p/' || page_id AS url FROM seen UNION ALL SELECT 'https://site.example/p/'""",
    "site_records": f"""WITH RECURSIVE {_SEEN}, c AS (SELECT page_id, html, {_code_free('html')} AS m
            FROM pages JOIN seen USING (page_id)),
        b AS (SELECT page_id, html, CASE WHEN regexp_matches(m, '{_MAIN}') THEN regexp_extract(m, '{_MAIN}', 1)
            ELSE m END AS m FROM c)
        SELECT * FROM (SELECT 'https://site.example/p/' || page_id AS url, 'site.example' AS host, {_TITLE} AS title,
            CAST(NULL AS VARCHAR) AS description, {_plain_text('m')} AS text FROM b) WHERE text <> ''
        UNION ALL SELECT 'https://site.example/p/', 'site.example', NULL, NULL, 'first'""",
}
