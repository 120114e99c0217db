"""DuckDB SQL for the registered queries, written on its own from their definitions."""

from __future__ import annotations

from ..functions.text import STOP_WORDS

WORD = r"[0-9A-Za-z][0-9A-Za-z''\x{80}-\x{10FFFF}]*"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)

_WITH = f"""
WITH lab AS (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
y AS (SELECT doc_id, CAST(CASE WHEN quality > 0 THEN 1 ELSE -1 END AS INTEGER) AS y FROM labels WHERE quality IS NOT NULL),
occ AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS feature FROM lab),
f AS (SELECT DISTINCT doc_id, feature FROM occ),
df AS (SELECT feature, count(*) AS df FROM f GROUP BY feature),
sizes AS (SELECT count(*) FILTER (WHERE y > 0) AS pos, count(*) FILTER (WHERE y < 0) AS neg FROM y),
tab AS (SELECT feature, count(*) FILTER (WHERE y > 0) AS tp, count(*) FILTER (WHERE y < 0) AS fp FROM f JOIN y USING (doc_id) GROUP BY feature),
t AS (SELECT * FROM tab, sizes WHERE tp + fp >= 2),
lo AS (SELECT feature, ln(greatest(tp, 0.1::DOUBLE) * greatest(neg - fp, 0.1::DOUBLE) / (greatest(fp, 0.1::DOUBLE) * greatest(pos - tp, 0.1::DOUBLE))) AS weight FROM t),
idf AS (SELECT feature, ln((pos + neg)::DOUBLE / (tp + fp)) AS weight FROM t),
len AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS score, CASE WHEN quality > 0 THEN 1 ELSE -1 END AS y, CAST(quality AS DOUBLE) AS target FROM lab WHERE quality IS NOT NULL)
"""

_A = "(8 * (pi() - 3) / (3 * pi() * (4 - pi())))"


def _inverse(p: str) -> str:
    x = f"(2 * {p} - 1)"
    log = f"ln(1 - {x} * {x})"
    half = f"(2 / (pi() * {_A}) + {log} / 2)"
    return f"(sqrt(2) * sign({x}) * sqrt(sqrt({half} * {half} - {log} / {_A}) - {half}))"


def _descent(steps: int) -> str:
    """The least objective of the machine that ``svc_objective`` trains, by so many steps of steepest descent, each a pair of sums."""
    parts = [f"""{_WITH}, raw AS (SELECT f.doc_id, f.feature, lo.weight, y.y FROM f JOIN lo USING (feature) JOIN y USING (doc_id) WHERE lo.weight <> 0),
        norm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM raw GROUP BY doc_id),
        x AS MATERIALIZED (SELECT doc_id, feature, weight / norm AS v, y, 0.00390625::DOUBLE * CASE WHEN y > 0 THEN 20.0 * neg / (pos + neg) ELSE 2.0 * pos / (pos + neg) END AS c FROM raw JOIN norm USING (doc_id), sizes),
        docs AS MATERIALIZED (SELECT DISTINCT doc_id, y, c FROM x), rate AS (SELECT 1 / (1 + 2 * sum(c)) AS r FROM docs),
        w0 AS MATERIALIZED (SELECT DISTINCT feature, 0::DOUBLE AS w FROM x)"""]
    for i in range(steps):
        parts.append(f"""m{i} AS MATERIALIZED (SELECT doc_id, greatest(0, 1 - any_value(y) * sum(v * w)) AS short FROM x JOIN w{i} USING (feature) GROUP BY doc_id),
        w{i + 1} AS MATERIALIZED (SELECT feature, any_value(w) - any_value(r) * (any_value(w) - sum(2 * c * y * short * v)) AS w FROM x JOIN m{i} USING (doc_id) JOIN w{i} USING (feature), rate GROUP BY feature)""")
    parts.append(f"""last AS (SELECT doc_id, greatest(0, 1 - any_value(y) * sum(v * w)) AS short FROM x JOIN w{steps} USING (feature) GROUP BY doc_id)
        SELECT round((SELECT sum(w * w) / 2 FROM w{steps}) + (SELECT sum(c * short * short) FROM docs JOIN last USING (doc_id)), 3) AS objective, TRUE AS certified""")
    return ",\n".join(parts[:-1]) + ",\n" + parts[-1]


_SCORES = f"""{_WITH},
every AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS feature FROM documents),
s AS (SELECT d.doc_id, coalesce(v / sqrt(nullif(ss, 0)), 0) AS score FROM documents d LEFT JOIN
 (SELECT doc_id, sum(weight * weight) AS v, sum(weight * weight) AS ss FROM every JOIN lo USING (feature) GROUP BY doc_id) USING (doc_id))
"""


def oracle_sql() -> dict[str, str]:
    words = f"SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS tok FROM documents"
    act = "(SELECT doc_id, feature, weight FROM f JOIN lo USING (feature))"
    auroc = """SELECT {by} round(sum(CASE WHEN y > 0 THEN below ELSE 0 END)::DOUBLE / (count(*) FILTER (WHERE y > 0) * count(*) FILTER (WHERE y < 0)), 6) AS auroc
        FROM (SELECT *, coalesce(sum(CASE WHEN y < 0 THEN 1 ELSE 0 END) OVER ({part} ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {rows}) {group}"""
    beta = """SELECT round((1 + {b}) * p * r / ({b} * p + r), 6) AS {name} FROM (SELECT
        count(*) FILTER (WHERE score > 1000 AND y > 0)::DOUBLE / count(*) FILTER (WHERE score > 1000) AS p, count(*) FILTER (WHERE score > 1000 AND y > 0)::DOUBLE / count(*) FILTER (WHERE y > 0) AS r FROM len)"""
    rmse = "sqrt(avg(pow(greatest(0, abs(score / {by} - target) - 0.1::DOUBLE), 2)))"
    return {
        "skipgram_vocabulary": f"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM l),
            g AS (SELECT doc_id, tok, NULL AS prev, 0 AS distance FROM t UNION ALL SELECT a.doc_id, a.tok, b.tok, CAST(a.pos - b.pos AS INTEGER) FROM t a JOIN (SELECT *, unnest([1, 2, 3]) AS d FROM t) b ON a.doc_id = b.doc_id AND a.pos = b.pos + b.d)
            SELECT tok, prev, distance, count(*) AS df FROM (SELECT DISTINCT * FROM g) GROUP BY ALL HAVING count(*) >= 2""",
        "fold_weights": f"""{_WITH}, dealt AS (SELECT doc_id, y, ((row_number() OVER (PARTITION BY y ORDER BY doc_id) - 1) * 5) // count(*) OVER (PARTITION BY y) AS fold FROM y),
            tr AS (SELECT held, doc_id, y FROM dealt, (SELECT unnest(range(5)) AS held) WHERE fold <> held),
            n AS (SELECT held, count(*) FILTER (WHERE y > 0) AS pos, count(*) FILTER (WHERE y < 0) AS neg FROM tr GROUP BY held),
            c AS (SELECT held, feature, count(*) FILTER (WHERE y > 0) AS tp, count(*) FILTER (WHERE y < 0) AS fp FROM f JOIN tr USING (doc_id) GROUP BY ALL HAVING count(*) >= 2)
            SELECT feature, CAST(held AS BIGINT) AS held, round(weight, 6) AS weight FROM (SELECT feature, held, ln(greatest(tp, 0.1::DOUBLE) * greatest(neg - fp, 0.1::DOUBLE) / (greatest(fp, 0.1::DOUBLE) * greatest(pos - tp, 0.1::DOUBLE))) AS weight FROM c JOIN n USING (held)) WHERE weight <> 0""",
        "svc_objective": _descent(60),
        "topic_machines": """SELECT topic, (SELECT count(*) FROM documents WHERE lang IS NOT NULL AND doc_id % 4 = 2) AS documents, count(*) FILTER (WHERE doc_id % 4 = 2) AS positive, TRUE AS separated, TRUE AS certified
            FROM (SELECT lang AS topic, doc_id FROM documents WHERE lang IS NOT NULL) GROUP BY topic""",
        "word_tokens": f"SELECT doc_id, tok, count(*) AS n FROM ({words}) GROUP BY ALL",
        "skipgrams": f"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM l),
            g AS (SELECT tok, NULL AS prev, 0 AS distance FROM t UNION ALL SELECT a.tok, b.tok, CAST(a.pos - b.pos AS INTEGER) FROM t a JOIN (SELECT *, unnest([1, 2, 3]) AS d FROM t) b ON a.doc_id = b.doc_id AND a.pos = b.pos + b.d)
            SELECT tok, prev, distance, count(*) AS n FROM g GROUP BY ALL""",
        "codepoint_features": r"SELECT doc_id, point, count(*) AS n FROM (SELECT doc_id, unicode(unnest(regexp_extract_all(text, '[^\x00-\x7F]'))) AS point FROM documents) GROUP BY ALL",
        "malformed_codepoints": r"""WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(hex(encode(text)), '(....)..', '\1', 'g'), '(..)', '\1 ', 'g') AS h FROM documents WHERE text IS NOT NULL),
            f AS (SELECT doc_id, list_transform(string_split(rtrim(unnest(regexp_extract_all(h, '[CD][0-9A-F] (?:[89AB][0-9A-F] )?|E[0-9A-F] (?:[89AB][0-9A-F] ){0,2}|F[0-7] (?:[89AB][0-9A-F] ){0,3}|F[89AB] (?:[89AB][0-9A-F] ){0,4}|F[CD] (?:[89AB][0-9A-F] ){0,5}|[89AB][0-9A-F] |F[EF] '))), ' '), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM h),
            p AS (SELECT doc_id, list_reduce(list_concat([CASE WHEN b[1] < 192 OR b[1] >= 254 THEN b[1] WHEN b[1] < 224 THEN b[1] & 31 WHEN b[1] < 240 THEN b[1] & 15 WHEN b[1] < 248 THEN b[1] & 7 WHEN b[1] < 252 THEN b[1] & 3 ELSE b[1] & 1 END], b[2:]), lambda v, x: v * 64 + (x & 63)) AS point FROM f)
            SELECT doc_id, CAST(point AS INTEGER) AS point, count(*) AS n FROM p WHERE point >= 128 GROUP BY ALL""",
        "byte_skipgrams": r"""WITH b AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: chr(CAST('0x' || x AS INTEGER))), '') AS s FROM documents),
            l AS (SELECT doc_id, regexp_extract_all(s, '[0-9A-Za-z][0-9A-Za-z''\x{80}-\x{ff}]*|[^\s\x0B][^\s\x0B0-9A-Za-z\x{80}-\x{ff}]*') AS l FROM b), t AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM l),
            g AS (SELECT tok, NULL AS prev, 0 AS distance FROM t UNION ALL SELECT a.tok, b.tok, CAST(a.pos - b.pos AS INTEGER) FROM t a JOIN (SELECT *, unnest([1, 2, 3]) AS d FROM t) b ON a.doc_id = b.doc_id AND a.pos = b.pos + b.d)
            SELECT tok, prev, distance, count(*) AS n FROM g GROUP BY ALL""",
        "framed_documents": "SELECT CAST(doc_id AS VARCHAR) AS key, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS digest FROM documents WHERE text <> ''",
        "substring_features": "SELECT substr(p_name, i::BIGINT, k::BIGINT) AS feature, count(*) AS n FROM (SELECT p_name, i, unnest(range(3, length(p_name) - i + 2)) AS k FROM (SELECT p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part)) GROUP BY ALL",
        "stopword_filter": f"SELECT doc_id, tok, count(*) AS n FROM ({words}) WHERE tok NOT IN ({_STOP}) GROUP BY ALL",
        "url_components": "SELECT page_id, part, count(*) AS n FROM (SELECT page_id, unnest(string_split(url, '/')) AS part FROM pages WHERE url LIKE 'http://%' OR url LIKE 'https://%') WHERE part <> '' GROUP BY ALL",
        "genotype_features": "SELECT CAST(l_linenumber AS VARCHAR) AS chrom, CAST(l_partkey AS VARCHAR) AS pos, l_returnflag || l_linestatus AS alleles, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL",
        "doc_feature_sets": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_features, md5(array_to_string(s, ' ')) AS digest FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '{WORD}'))) AS s FROM documents)",
        "label_binarize": f"{_WITH} SELECT * FROM y",
        "doc_frequency": f"{_WITH} SELECT * FROM df",
        "df_filter": f"{_WITH} SELECT * FROM df WHERE df >= 2",
        "feature_pass_stats": f"{_WITH} SELECT count(*) AS n_features, count(*) FILTER (WHERE df >= 2) AS n_passing FROM df",
        "feature_dictionary": f"{_WITH} SELECT feature, row_number() OVER (ORDER BY feature) AS idx FROM df WHERE df >= 2",
        "vocab_semi_join": f"{_WITH} SELECT f.doc_id, f.feature FROM f JOIN df USING (feature) WHERE df >= 2",
        "feature_counts": f"{_WITH} SELECT doc_id, feature, least(255, count(*) - 1) AS extra FROM occ GROUP BY ALL",
        "empty_docs": f"{_WITH} SELECT doc_id FROM lab WHERE doc_id NOT IN (SELECT doc_id FROM f JOIN df USING (feature) WHERE df >= 25)",
        "max_doc_features": f"{_WITH} SELECT max(n) AS most FROM (SELECT count(*) AS n FROM f JOIN df USING (feature) WHERE df >= 2 GROUP BY doc_id)",
        "target_centering": "SELECT doc_id, round(quality - (SELECT avg(quality) FROM labels), 6) AS target FROM labels",
        "contingency": f"{_WITH} SELECT * FROM tab",
        "bns_weights": f"""{_WITH}, r AS (SELECT feature, least(0.0005::DOUBLE, 1::DOUBLE / (pos + neg)) AS m, tp::DOUBLE / pos AS a, fp::DOUBLE / neg AS b FROM t),
            c AS (SELECT feature, greatest(m, least(1 - m, a)) AS a, greatest(m, least(1 - m, b)) AS b FROM r) SELECT feature, round({_inverse("a")} - {_inverse("b")}, 6) AS weight FROM c""",
        "idf_weights": f"{_WITH} SELECT feature, round(weight, 6) AS weight FROM idf",
        "log_odds_weights": f"{_WITH} SELECT feature, round(weight, 6) AS weight FROM lo",
        "unit_weights": f"{_WITH} SELECT feature, 1::DOUBLE AS weight FROM t",
        "count_threshold_search": f"""{_WITH}, n AS (SELECT doc_id, feature, least(255, count(*) - 1) AS extra FROM occ GROUP BY ALL),
            lv AS (SELECT feature, extra, count(*) FILTER (WHERE y > 0) AS p, count(*) FILTER (WHERE y < 0) AS q FROM n JOIN y USING (doc_id) GROUP BY ALL),
            cu AS (SELECT feature, extra, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM lv WINDOW w AS (PARTITION BY feature ORDER BY extra DESC)),
            we AS (SELECT feature, extra, CASE WHEN tp + fp < 2 THEN 0 ELSE ln(greatest(tp, 0.1::DOUBLE) * greatest(neg - fp, 0.1::DOUBLE) / (greatest(fp, 0.1::DOUBLE) * greatest(pos - tp, 0.1::DOUBLE))) END AS w FROM cu, sizes),
            rk AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(abs(w), 9) DESC, extra DESC) AS i FROM we)
            SELECT feature, round(w, 6) AS weight, CASE WHEN w = 0 THEN 0 ELSE extra END AS min_extra FROM rk WHERE i = 1""",
        "doc_l2_norm": f"{_WITH} SELECT doc_id, round(CASE WHEN sum(weight * weight) > 0 THEN 1 / sqrt(sum(weight * weight)) ELSE 0 END, 6) AS scale FROM {act} GROUP BY doc_id",
        "doc_svr_scale": f"{_WITH} SELECT doc_id, round(CASE WHEN sum(weight * weight) > 0 THEN 1 / sum(weight * weight) ELSE 0 END, 9) AS scale FROM {act} GROUP BY doc_id",
        "doc_dot": f"{_WITH} SELECT doc_id, round(sum(a.weight * idf.weight), 5) AS dot FROM {act} a JOIN idf USING (feature) GROUP BY doc_id",
        "auroc": _WITH + auroc.format(by="", part="", rows="len", group=""),
        "auroc_by_language": _WITH + auroc.format(by="lang,", part="PARTITION BY lang", rows="(SELECT len.*, lang FROM len JOIN documents USING (doc_id))", group="GROUP BY lang"),
        "f_beta": _WITH + beta.format(b="4", name="f_beta"),
        "precision": _WITH + beta.format(b="0", name="precision"),
        "eps_rmse": f"{_WITH} SELECT round({rmse.format(by=2500)}, 6) AS eps_rmse FROM len",
        "cv_summary": f"""{_WITH}, m AS (SELECT cost, doc_id % 5 AS fold, {rmse.format(by="(1000 * cost)")} AS metric FROM len, (SELECT unnest([1::DOUBLE, 2, 4]) AS cost) GROUP BY ALL)
            SELECT cost, round(avg(metric), 6) AS mean_metric, round(min(metric), 6) AS min_metric, round(max(metric), 6) AS max_metric FROM m GROUP BY cost""",
        "fold_count": f"{_WITH} SELECT greatest(2, least(pos // 2, neg // 2, 10)) AS k FROM sizes",
        "stratified_folds": f"{_WITH} SELECT doc_id, ((row_number() OVER (PARTITION BY y ORDER BY doc_id) - 1) * 5) // count(*) OVER (PARTITION BY y) AS fold FROM y",
        "round_robin_folds": f"{_WITH} SELECT doc_id, (row_number() OVER (ORDER BY y, doc_id) - 1) % 10 AS fold FROM y",
        "c_min": f"""{_WITH} SELECT pow(2::DOUBLE, greatest(-10, floor(log2(1 / (2::DOUBLE * (SELECT count(*) FROM y) * (SELECT max(n) FROM (SELECT count(*) AS n FROM f JOIN df USING (feature) WHERE df >= 2 GROUP BY doc_id)))))) ) AS c_min""",
        "class_balance": f"{_WITH} SELECT round(2::DOUBLE * neg / (pos + neg), 6) AS cost_pos, round(2::DOUBLE * pos / (pos + neg), 6) AS cost_neg FROM sizes",
        "classify_docs": f"{_SCORES} SELECT doc_id, round(score, 6) AS score FROM s",
        "decisions": f"{_SCORES} SELECT round(score, 6) > 0 AS positive, count(*) AS n FROM s GROUP BY ALL",
        "minmax_calibrate": f"""{_SCORES}, e AS (SELECT least(0::DOUBLE, min(score)) AS lo, greatest(0::DOUBLE, max(score)) AS hi FROM s)
            SELECT doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 6) AS calibrated FROM s, e""",
    }
