"""Queries of the joins with entities, sentences and dictionaries, and of entities made from determiners and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom import derived
from textloom import fixtures as fx
from textloom.operators import entities, linking
from textloom.queries import query

ENTITY_TEXTS = """ns AS (SELECT doc_id, text, max(struct_pack(s := start, e := "end", id := entity_id)).id AS entity_id, min(struct_pack(s := start, e := "end", id := entity_id)) AS place, arg_min(category, struct_pack(s := start, e := "end", id := entity_id)) AS category FROM named GROUP BY doc_id, text)"""


@query(
    derived.with_tables("named", "spoken") + f""", {ENTITY_TEXTS},
m AS (SELECT s.doc_id, s.arg_id, n.entity_id, row_number() OVER (PARTITION BY s.doc_id, s.arg_id ORDER BY CASE WHEN n.text = s.text THEN 0 ELSE 1 END, least(length(n.text), length(s.text)) DESC, n.place) AS k
  FROM spoken s JOIN ns n ON n.doc_id = s.doc_id AND length(s.text) > 0 AND (contains(n.text, s.text) OR contains(s.text, n.text)))
SELECT s.doc_id, s.arg_id, m.entity_id FROM spoken s LEFT JOIN m ON m.doc_id = s.doc_id AND m.arg_id = s.arg_id AND k = 1"""
)
def linked_arguments(spark, sf_dir):
    return linking.linked(derived.frame(spark, sf_dir, "spoken"), derived.frame(spark, sf_dir, "named")).select("doc_id", "arg_id", "entity_id")


@query(
    derived.with_tables("spoken", "sentence_places") + """, m AS (SELECT s.doc_id, s.arg_id, p.sent_idx, row_number() OVER (PARTITION BY s.doc_id, s.arg_id ORDER BY CASE WHEN p.start <= s.start AND s.start < p."end" THEN 0 ELSE 1 END, p.sent_idx) AS k
  FROM spoken s JOIN sentence_places p ON p.doc_id = s.doc_id AND length(s.text) > 0 AND ((p.start <= s.start AND s.start < p."end") OR contains(p.text, s.text)))
SELECT s.doc_id, s.arg_id, CAST(coalesce(m.sent_idx, -1) AS INTEGER) AS sentence_index FROM spoken s LEFT JOIN m ON m.doc_id = s.doc_id AND m.arg_id = s.arg_id AND k = 1"""
)
def argument_sentences(spark, sf_dir):
    return linking.in_sentences(derived.frame(spark, sf_dir, "spoken"), derived.frame(spark, sf_dir, "sentence_places")).select("doc_id", "arg_id", "sentence_index")


def best_name(side: str) -> str:
    """The entity an endpoint is, or else the longest within it."""
    return f"(SELECT n.text FROM ns n WHERE n.doc_id = c.doc_id AND contains(c.{side}, n.text) ORDER BY length(n.text) DESC, n.place LIMIT 1)"


@query(
    derived.with_tables("named", "claims") + f""", {ENTITY_TEXTS},
h AS (SELECT c.*, {best_name('subject')} AS s, {best_name('object')} AS o, c.doc_id IN (SELECT doc_id FROM named) AS linkable FROM claims c)
SELECT doc_id, rel_id, coalesce(s, subject) AS subject, coalesce(o, object) AS object FROM h
WHERE NOT linkable OR ((s IS NOT NULL OR o IS NOT NULL) AND subject <> '之' AND object <> '之')"""
)
def known_endpoints(spark, sf_dir):
    return linking.with_known_endpoints(derived.frame(spark, sf_dir, "claims"), derived.frame(spark, sf_dir, "named"), ["之"]).select("doc_id", "rel_id", "subject", "object")


@query(
    derived.with_tables("named", "claims", "category_pairs", "verb_predicates") + f""", {ENTITY_TEXTS}
SELECT c.doc_id, c.rel_id, CASE WHEN s.category IS NULL OR o.category IS NULL THEN c.predicate WHEN p.predicate IS NOT NULL THEN p.predicate WHEN v.predicate IS NOT NULL THEN v.predicate
  WHEN predicate_verb IN ('至', '往', '来', '适', '迁', '赴', '归', '还', '入', '出') AND o.category = 'LOCATION' THEN 'MOVED_TO'
  WHEN predicate_verb IN ('至', '往', '来', '适', '迁', '赴', '归', '还', '入', '出') AND s.category = 'LOCATION' THEN 'DEPARTED_FROM'
  WHEN predicate_verb IN ('为', '乃', '即', '系', '是') THEN 'IS_A' ELSE 'RELATES_TO' END AS predicate
FROM claims c LEFT JOIN ns s ON s.doc_id = c.doc_id AND s.text = c.subject LEFT JOIN ns o ON o.doc_id = c.doc_id AND o.text = c.object
LEFT JOIN category_pairs p ON p.subject_category = s.category AND p.object_category = o.category LEFT JOIN verb_predicates v ON v.verb = c.predicate_verb"""
)
def typed_predicates(spark, sf_dir):
    found = linking.with_typed_predicates(derived.frame(spark, sf_dir, "claims"), derived.frame(spark, sf_dir, "named"), fx.frame(spark, "category_pairs"), fx.frame(spark, "verb_predicates"))
    return found.select("doc_id", "rel_id", "predicate")


def through(side: str) -> str:
    """Steps of one side: the longest mention the raw text begins with, what its chain stands for, the widest entity."""
    rep = f"(SELECT m.representative FROM mentions m WHERE m.doc_id = c.doc_id AND starts_with(c.{side}_raw, m.text) ORDER BY length(m.text) DESC, m.chain_id DESC LIMIT 1)"
    return f"""r_{side} AS (SELECT c.*, {rep} AS rep FROM claims c),
t_{side} AS (SELECT c.*, CASE WHEN left(rep, 1) IN ('该', '此', '本', '其', '彼', '是')
  THEN coalesce((SELECT n.text FROM ns n WHERE n.doc_id = c.doc_id AND contains(n.text, substr(c.rep, 2)) ORDER BY n.place LIMIT 1), substr(rep, 2)) ELSE rep END AS stands FROM r_{side} c),
u_{side} AS (SELECT c.*, coalesce(CASE WHEN stands <> {side}_raw THEN stands END, {side}) AS own FROM t_{side} c),
w_{side} AS (SELECT doc_id, rel_id, own, coalesce((SELECT n.text FROM ns n WHERE n.doc_id = c.doc_id AND (contains(n.text, c.own) OR contains(n.text, c.{side}_raw)) AND length(c.own) < length(n.text) ORDER BY length(n.text) DESC, n.place LIMIT 1), own) AS wide FROM u_{side} c)"""


@query(
    derived.with_tables("named", "claims", "mentions") + f""", {ENTITY_TEXTS}, {through('subject')}, {through('object')}
SELECT c.doc_id, c.rel_id, CASE WHEN c.source LIKE '%classical_pattern%' AND c.predicate IN ('HAS_STYLE_NAME', 'EQUIVALENT_TO') THEN c.subject WHEN s.wide = o.wide THEN s.own ELSE s.wide END AS subject,
  CASE WHEN c.source LIKE '%classical_pattern%' AND c.predicate IN ('HAS_STYLE_NAME', 'EQUIVALENT_TO') THEN c.object WHEN s.wide = o.wide THEN o.own ELSE o.wide END AS object
FROM claims c JOIN w_subject s USING (doc_id, rel_id) JOIN w_object o USING (doc_id, rel_id)"""
)
def endpoints_through_chains(spark, sf_dir):
    return linking.through_chains(derived.frame(spark, sf_dir, "claims"), derived.frame(spark, sf_dir, "mentions"), derived.frame(spark, sf_dir, "named")).select("doc_id", "rel_id", "subject", "object")


NEAREST = """FROM triggers t JOIN sentence_places p ON p.doc_id = t.doc_id AND p.sent_idx = t.sentence_index
  JOIN named n ON n.doc_id = t.doc_id AND n.start >= p.start AND n.start < p."end"
  WHERE NOT EXISTS (SELECT 1 FROM trigger_arguments a WHERE a.doc_id = t.doc_id AND a.event_id = t.event_id AND (a.role = '{role}' OR a.text = n.text)) AND {rule}
  QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.event_id ORDER BY abs(n.start + n."end" - t.start - t."end"), n.start, n."end", n.entity_id) = 1"""


@query(
    derived.with_tables("named", "triggers", "trigger_arguments", "sentence_places") + f"""
SELECT t.doc_id, t.event_id, 'Time' AS role, n.text, n.entity_id, n.start, n."end" {NEAREST.format(role='Time', rule="n.category = 'DATE' AND NOT regexp_full_match(n.text, '[0-9]+') AND regexp_matches(n.text, '[日月年时分秒周天点刻]')")}
UNION ALL SELECT t.doc_id, t.event_id, 'Location' AS role, n.text, n.entity_id, n.start, n."end" {NEAREST.format(role='Location', rule="n.category IN ('LOCATION', 'FACILITY')")}"""
)
def missing_circumstances(spark, sf_dir):
    return linking.missing_circumstances(derived.frame(spark, sf_dir, "triggers"), derived.frame(spark, sf_dir, "trigger_arguments"), derived.frame(spark, sf_dir, "named"), derived.frame(spark, sf_dir, "sentence_places"))


@query(
    derived.with_tables("characters", "register") + """, runs AS (SELECT a.doc_id, a.text AS t1, a.text || b.text AS t2, a.text || b.text || c.text AS t3, a.text || b.text || c.text || d.text AS t4 FROM characters a
  LEFT JOIN characters b ON b.doc_id = a.doc_id AND b.tok_idx = a.tok_idx + 1 AND b.start = a."end" LEFT JOIN characters c ON c.doc_id = b.doc_id AND c.tok_idx = b.tok_idx + 1 AND c.start = b."end"
  LEFT JOIN characters d ON d.doc_id = c.doc_id AND d.tok_idx = c.tok_idx + 1 AND d.start = c."end"),
made AS (SELECT doc_id, t1 AS text FROM runs UNION SELECT doc_id, t2 FROM runs UNION SELECT doc_id, t3 FROM runs UNION SELECT doc_id, t4 FROM runs),
kinds(category, rank, confidence) AS (VALUES ('ERA', 1, 0.95), ('TITLE', 2, 0.9), ('LOCATION', 3, 0.9), ('PERSON', 4, 0.85))
SELECT m.doc_id, m.text, k.category, CAST(k.confidence AS DOUBLE) AS confidence FROM made m JOIN register r ON r.text = m.text JOIN kinds k ON k.category = r.category QUALIFY row_number() OVER (PARTITION BY m.doc_id, m.text ORDER BY k.rank) = 1"""
)
def dictionary_names(spark, sf_dir):
    return linking.names_of(derived.gathered(spark, sf_dir, "characters").withColumnRenamed("characters", "tokens"), fx.frame(spark, "register"))


@query(
    derived.with_tables("cup_tokens", "cup_deps", "cup_entities") + """,
d AS (SELECT e.doc_id, e.entity_id, e.category, e.source, e.confidence, least(min(d.child), any_value(t.tok_idx)) AS lo, greatest(max(d.child), any_value(t.tok_idx)) AS hi
  FROM cup_entities e JOIN cup_tokens t ON t.doc_id = e.doc_id AND t.start = e.start AND t."end" = e."end" AND t.text = e.text JOIN cup_deps d ON d.doc_id = e.doc_id AND d.head = t.tok_idx AND lower(d.rel) = 'det' GROUP BY ALL)
SELECT doc_id, text, category, start, "end", source, CAST(confidence AS DOUBLE) AS confidence FROM cup_entities
UNION ALL SELECT d.doc_id, string_agg(t.text, '' ORDER BY t.tok_idx), d.category, min(t.start), max(t."end"), d.source, CAST(d.confidence AS DOUBLE) FROM d JOIN cup_tokens t ON t.doc_id = d.doc_id AND t.tok_idx BETWEEN lo AND hi GROUP BY d.doc_id, d.entity_id, d.category, d.source, d.confidence"""
)
def entities_with_determiners(spark, sf_dir):
    # cup_tokens and cup_deps are those of the clauses
    docs = derived.gathered(spark, sf_dir, "cup_entities", "clause_tokens", "clause_deps")
    return entities.determiners_of(docs.withColumnsRenamed({"cup_entities": "entities", "clause_tokens": "tokens", "clause_deps": "deps"})).drop("entity_id")


@query(
    derived.with_tables("cup_tokens", "cup_entities", "discovered") + """, texts AS (SELECT doc_id, string_agg(text, '' ORDER BY tok_idx) AS text FROM cup_tokens GROUP BY doc_id),
p AS (SELECT f.doc_id, f.word AS text, CAST(instr(t.text, f.word) - 1 AS INTEGER) AS start, score FROM discovered f JOIN texts t USING (doc_id) WHERE contains(t.text, f.word))
SELECT doc_id, text, 'UNKNOWN' AS category, start, CAST(start + length(text) AS INTEGER) AS "end", 'discover' AS source, CAST(least(0.85, 0.5 + 0.05 * score) AS DOUBLE) AS confidence
FROM p WHERE NOT EXISTS (SELECT 1 FROM cup_entities e WHERE e.doc_id = p.doc_id AND e.start = p.start AND e."end" = p.start + length(p.text))"""
)
def entities_from_discovery(spark, sf_dir):
    tokens = derived.frame(spark, sf_dir, "cup_tokens").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", "text"))), lambda t: t["text"]), "").alias("text"))
    return entities.discovered_entities(derived.frame(spark, sf_dir, "discovered"), tokens, derived.frame(spark, sf_dir, "cup_entities"))
