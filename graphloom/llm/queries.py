"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import abuse, packing, provenance, syntax, terms, tokens
from graphloom.sources.tables import table


def p1_found(spark, d):
    return syntax.broken_files(table(spark, d, "tree"), table(spark, d, "nodes"), table(spark, d, "ext_catalogue")).select("project", "path")


def p1_rates(spark, d):
    return syntax.broken_rates(*(table(spark, d, t) for t in ("tree", "nodes", "ext_catalogue", "failures")))


def p2_found(spark, d):
    return terms.marked_terms(table(spark, d, "nodes"))


def p2_terms(spark, d):
    return terms.term_counts(table(spark, d, "nodes"))


def p4_found(spark, d):
    return provenance.not_handwritten(table(spark, d, "nodes"), table(spark, d, "tree"))


def p4_labels(spark, d):
    """The label of every source file."""
    return provenance.provenance(table(spark, d, "nodes"), table(spark, d, "tree")).select("project", "path", "label")


def p5_found(spark, d):
    return terms.co_occurrence(table(spark, d, "nodes")).select("name_a", "name_b")


def p5_pairs(spark, d):
    out = terms.co_occurrence(table(spark, d, "nodes"), min_joint=5, min_share=2000, min_lift=1.0, min_llr=None)
    return out.withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})


def p5_all_pairs(spark, d):
    """Every pair that occurs, with the verdict of the log-likelihood ratio at 0.1 %."""
    out = terms.co_occurrence(table(spark, d, "nodes"), min_joint=1, min_share=None, min_lift=0.0, min_llr=None)
    out = out.withColumns({"lift": F.round("lift", 6), "llr": F.round(F.greatest("llr", F.lit(0.0)), 4)})
    return out.withColumn("significant", F.col("llr") >= terms.LLR_SIGNIFICANT)


def p7_ids(spark, d):
    return tokens.encode(table(spark, d, "documents").select("doc_id", "text"))


def p7_decoded(spark, d):
    """The texts again, out of their ids."""
    return tokens.decode(p7_ids(spark, d))


def p8_containers(spark, d):
    return packing.pack(tokens.token_counts(table(spark, d, "documents").select("doc_id", "text")))


def p8_fill(spark, d):
    return packing.fill_report(p8_containers(spark, d))


def p9_found(spark, d):
    return abuse.abusive_documents(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "abuse_labels")).select("doc_id")


def p9_rates(spark, d):
    return abuse.abuse_rates(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "abuse_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_terms, p4_found, p4_labels, p5_found, p5_pairs, p5_all_pairs, p7_ids, p7_decoded, p8_containers, p8_fill, p9_found, p9_rates)}

_WS = r"[\s\pZ\x0b\x{1c}-\x{1f}\x{85}]+"
_RECORDS = f"""
records AS (SELECT project, id, external_deps FROM (
  SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY scanned_at DESC NULLS LAST, loaded_at DESC NULLS LAST, external_deps DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1),
raw AS (SELECT project, id, unnest(external_deps) AS name FROM records),
terms AS (SELECT project, id, lower(regexp_replace(name, '^{_WS}|{_WS}$', '', 'g')) AS name FROM raw WHERE name IS NOT NULL),
tf AS (SELECT project, id, name, count(*) AS tf FROM terms WHERE name <> '' GROUP BY ALL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT project, id FROM tf)),
df AS (SELECT name, sum(tf)::BIGINT AS occurrences, count(*) AS n_records FROM tf GROUP BY name)"""
_PAIRS = f"""
WITH {_RECORDS.strip()},
k AS (SELECT x.name AS name_a, y.name AS name_b, count(*) AS k_ab FROM tf x JOIN tf y ON x.project = y.project AND x.id = y.id AND x.name < y.name GROUP BY ALL),
p AS (SELECT k.*, a.n_records AS k_a, b.n_records AS k_b, n.n FROM k JOIN df a ON a.name = name_a JOIN df b ON b.name = name_b, n WHERE k_ab >= 5 AND 2000 * k_ab >= n.n)"""
_ALL_PAIRS = _PAIRS.removesuffix(" WHERE k_ab >= 5 AND 2000 * k_ab >= n.n)") + ")"
_H = "(CASE WHEN {0} > 0 THEN ({0})::DOUBLE * ln({0}) ELSE 0 END)"
_LLR = "2 * (" + " + ".join(_H.format(x) for x in ("k_ab", "(k_a - k_ab)", "(k_b - k_ab)", "(n - k_a - k_b + k_ab)")) + " - " + " - ".join(_H.format(x) for x in ("k_a", "(n - k_a)", "k_b", "(n - k_b)")) + " + " + _H.format("n") + ")"

SQL = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_found": f"WITH {_RECORDS.strip()} SELECT name, 'rare' AS mark FROM df WHERE n_records < 3 UNION ALL SELECT name, 'common' FROM df, n WHERE n_records * 100 > n * 5",
    "p2_terms": f"WITH {_RECORDS.strip()} SELECT name, occurrences, n_records, n_records / n AS share, n_records < 3 AS is_rare, n_records * 100 > n * 5 AS is_common FROM df, n",
    "p5_found": f"{_PAIRS} SELECT name_a, name_b FROM p WHERE k_ab * n >= 30 * k_a * k_b",
    "p5_pairs": f"{_PAIRS} SELECT name_a, name_b, k_a, k_b, k_ab, n, round(k_ab::DOUBLE * n / (k_a::DOUBLE * k_b), 6) AS lift, round({_LLR}, 4) AS llr FROM p WHERE k_ab * n >= 1 * k_a * k_b",
    "p5_all_pairs": f"{_ALL_PAIRS} SELECT *, llr >= 10.828 AS significant FROM (SELECT name_a, name_b, k_a, k_b, k_ab, n, round(k_ab::DOUBLE * n / (k_a::DOUBLE * k_b), 6) AS lift, round(greatest({_LLR}, 0), 4) AS llr FROM p)",
}
