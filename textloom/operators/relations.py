"""Relations, dependencies, events and noun signals, from tables of annotations.

Tables: frames (doc_id, frame_idx, text, role, start, end), tokens (doc_id, tok_idx, text, pos, start, end), deps
(doc_id, child, head, rel) with head -1 for the root, relations (doc_id, rel_id, subject, predicate, predicate_verb,
semantic_class, object, ...), events and event arguments. All joins have ``doc_id`` in their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import spans, text
from textloom.operators.gathering import bound, each, first_of, gathered, has, in_groups

# Pairs of roles that make a relation, in order.
ROLE_PAIRS = [("arg0", r) for r in ["arg1", "arg2", "argm-loc", "argm-tmp", "argm-mnr", "argm-cau", "argm-prd", "argm-ben", "argm-rec", "argm-src"]] + [("arg1", r) for r in ["argm-loc", "arg2", "argm-prd"]]
# Conjunctions that join several subjects or objects, in order of replacement.
CONJUNCTIONS = ["以及", "和", "与", "及", "或", "、", "暨", "幷", "並", "共", "俱", "皆", "仍", "复", "复又", " and ", " or "]
# Dependency relations as syntactic roles; scores of noun signals.
SYNTACTIC_ROLES = {"nsubj": "Subject", "nsubjpass": "Subject", "dobj": "Object", "iobj": "Object", "loc": "Adverbial", "lobj": "Adverbial", "nn": "Attributive", "amod": "Attributive"}
POS_SCORES = {"NN": 0.5, "NR": 0.4, "NT": 0.4, "JJ": 0.3}
ROLE_BONUS = {"Subject": 0.2, "Object": 0.2, "Adverbial": 0.1, "Attributive": 0.05}
# Verbs that trigger no event.
STOP_TRIGGERS = ["是", "有", "在", "为", "作", "成", "当", "像", "够", "了", "着", "过", "吗", "吧", "呢", "啊", "呀", "把", "被", "给", "对", "对于", "关于", "和", "与", "及", "或", "而", "但", "做", "搞", "弄", "通过", "经过", "按照", "根据"]
# Parts of an event's confidence.
EVENT_BASE, EVENT_ROOT, EVENT_AGENT, EVENT_PATIENT, EVENT_LONG, EVENT_MARK, EVENT_DISPUTED, EVENT_GENERIC, LONG_ARGUMENT = 0.70, 0.15, 0.10, 0.10, 0.15, 0.20, 0.10, 0.10, 15


def lookup(values: dict[str, object], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def from_frames(frames: DataFrame) -> DataFrame:
    """Relations of each semantic frame: the first argument of each role, paired as listed."""
    role = F.lower("role")
    order = Window.partitionBy("doc_id", "frame_idx", "role").orderBy("start", "end")
    first = frames.withColumn("role", role).withColumn("__r", F.row_number().over(order)).where("__r = 1")
    by_frame = first.groupBy("doc_id", "frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("role", F.struct("text", "start", "end")))).alias("args"), F.max(F.when(F.col("role") == "pred", F.col("text"))).alias("verb"))
    pairs = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(ROLE_PAIRS)])
    rows = by_frame.select("doc_id", "frame_idx", F.coalesce("verb", F.lit("")).alias("verb"), "args", F.explode(pairs).alias("p"))
    rows = rows.select("doc_id", "frame_idx", "verb", "p.n", F.col("p.b").alias("role"), F.try_element_at("args", "p.a").alias("s"), F.try_element_at("args", "p.b").alias("o")).where("s is not null and o is not null")
    return rows.select(
        "doc_id", "frame_idx", F.col("n").alias("pair"), text.strip(F.col("s.text")).alias("subject"), F.col("verb").alias("predicate_verb"), text.strip(F.col("o.text")).alias("object"), "role",
        F.least("s.start", "o.start").alias("start"), F.greatest("s.end", "o.end").alias("end"), F.lit(0.60).alias("confidence"), F.concat(F.lit("srl/"), F.col("verb")).alias("source"),
    )


def with_predicates(relations: DataFrame, verbs: DataFrame, roles: DataFrame) -> DataFrame:
    """Predicates by dimension tables: the verb's (verb, predicate, semantic_class), else the role's (role, predicate,
    semantic_class), else RELATES_TO."""
    v = verbs.select(F.col("verb").alias("predicate_verb"), F.col("predicate").alias("p1"), F.col("semantic_class").alias("c1"))
    r = roles.select("role", F.col("predicate").alias("p2"), F.col("semantic_class").alias("c2"))
    found = relations.join(v, "predicate_verb", "left").join(r, "role", "left")
    return found.withColumn("predicate", F.coalesce("p1", "p2", F.lit("RELATES_TO"))).withColumn("semantic_class", F.coalesce("c1", "c2")).drop("p1", "p2", "c1", "c2")


def split_conjunctions(relations: DataFrame, conjunctions: list[str] | None = None) -> DataFrame:
    """One relation for each pair of parts of subject and object; all other columns stay."""

    def parts(c: Column) -> Column:
        out = c
        for word in conjunctions or CONJUNCTIONS:
            out = F.replace(out, F.lit(word), F.lit("\x1f"))
        found = F.filter(F.transform(F.split(out, "\x1f"), text.strip), lambda p: p != "")
        return F.when(F.size(found) > 1, found).otherwise(F.array(c))

    rows = relations.withColumn("subject", F.explode(parts(F.col("subject"))))
    return rows.withColumn("object", F.explode(parts(F.col("object")))).select(*relations.columns)


def attributes(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``relations`` with is_attribute: a property whose object is no entity of the document, or a number, date or parameter."""
    e = entities.groupBy("doc_id", F.col("text").alias("object")).agg(F.max_by("category", "start").alias("__category"))
    found = relations.join(e, ["doc_id", "object"], "left")
    value = F.col("__category").isNull() | F.col("__category").isin("PARAMETER", "NUMBER", "DATE")
    return found.withColumn("is_attribute", F.col("predicate").isin("HAS_PROPERTY", "PROPERTY_OF") & value).drop("__category")


def bridges(deps: DataFrame, tokens: DataFrame) -> DataFrame:
    """Subject, verb and object of verbs that have both: a self-join of the edges on the head."""
    s = deps.where(F.lower("rel").isin("nsubj", "nsubjpass")).select("doc_id", "head", F.col("child").alias("s"))
    o = deps.where(F.lower("rel").isin("dobj", "obj", "iobj")).select("doc_id", "head", F.col("child").alias("o"))
    t = tokens.select("doc_id", "tok_idx", "text")
    name = lambda key, out: t.select("doc_id", F.col("tok_idx").alias(key), F.col("text").alias(out))
    found = s.join(o, ["doc_id", "head"]).where("head >= 0")
    return found.join(name("s", "subject"), ["doc_id", "s"]).join(name("o", "object"), ["doc_id", "o"]).join(name("head", "predicate_verb"), ["doc_id", "head"]).select("doc_id", "subject", "predicate_verb", "object", F.lit(0.60).alias("confidence"))


def heads_of(deps: Column, t: Column) -> Column:
    """By token with a head, in their order, structs (child, head, rel, at, word): where the head's own struct stands, -1 if nowhere, and
    in ``word`` the nearest ancestor that is a verb.

    What is not known yet of a token is what is known of where it points to, so that it points twice as far after each round."""
    arcs = F.array_sort(F.transform(F.filter(deps, lambda d: d["child"] >= 0), lambda d: F.struct(*[d[c].alias(c) for c in ("child", "head", "rel")])))
    # a token hangs on the last of its heads, by the last name
    one = lambda g: F.struct(F.get(g, 0)["child"].alias("child"), F.array_max(F.transform(g, lambda d: d["head"])).alias("head"), F.array_max(F.transform(g, lambda d: d["rel"])).alias("rel"))
    place = lambda up, h: F.when(F.get(up, h)["child"] == h, h).otherwise(F.coalesce(F.array_position(F.transform(up, lambda x: x["child"]), h), F.lit(0)).cast("int") - 1)
    # words mostly stand where their number says
    token = lambda h: F.when(F.get(t, h)["tok_idx"] == h, F.get(t, h)).otherwise(first_of(t, lambda w: w["tok_idx"] == h))
    verb = lambda w: F.when(F.startswith(F.coalesce(w["pos"], F.lit("")), F.lit("V")), w["text"])
    row = lambda u, at, word: F.struct(u["child"].alias("child"), u["head"].alias("head"), u["rel"].alias("rel"), at.cast("int").alias("at"), word.alias("word"))
    start = lambda up: F.transform(up, lambda u: row(u, place(up, u["head"]), bound(token(u["head"]), verb)))
    open_ = lambda u: u["word"].isNull() & (u["at"] >= 0)
    step = lambda acc: F.transform(acc, lambda u: F.when(open_(u), bound(F.get(acc, u["at"]), lambda v: row(u, v["at"], v["word"]))).otherwise(u))
    rounds = lambda s: F.sequence(F.lit(0), F.ceil(F.log2(F.size(s).cast("double") + 1)).cast("int"))
    walk = lambda s: F.aggregate(rounds(s), s, lambda acc, _: F.when(has(acc, open_), step(acc)).otherwise(acc))
    return bound(bound(F.transform(in_groups(arcs, "child"), one), start), walk)


def governing_verbs(deps: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each token with a head, the nearest ancestor that is a verb: rows (doc_id, tok_idx, governing_verb)."""
    docs = gathered(tokens=tokens.select("doc_id", "tok_idx", "text", "pos"), deps=deps.select("doc_id", "child", "head", "rel"))
    found = bound(F.array_sort("tokens"), lambda t: heads_of(F.col("deps"), t))
    return each(docs.withColumn("__up", found), "__up", "u", "doc_id").select("doc_id", F.col("u.child").alias("tok_idx"), F.col("u.word").alias("governing_verb"))


def noun_signals(tokens: DataFrame, deps: DataFrame, whitelist: tuple[str, ...] = ("NN", "NR"), least: float = 0.3, most: int = 30) -> DataFrame:
    """The salient nouns of each document: rank by score, then place; ``most`` a document. They are found within one row for each
    document, into which its tables are gathered."""
    docs = gathered(tokens=tokens.select("doc_id", "tok_idx", "text", "pos", "start", "end"), deps=deps.select("doc_id", "child", "head", "rel"))
    return noun_signals_of(docs, whitelist, least, most)


def noun_signals_of(docs: DataFrame, whitelist: tuple[str, ...] = ("NN", "NR"), least: float = 0.3, most: int = 30) -> DataFrame:
    """The same of gathered documents (doc_id, tokens, deps)."""
    t = F.array_sort(F.transform("tokens", lambda x: F.struct(*[x[c].alias(c) for c in ("tok_idx", "text", "pos", "start", "end")])))
    nouns = lambda t: F.filter(t, lambda x: x["pos"].isin(*whitelist) & (F.length(x["text"]) >= 2))
    arc = lambda up, i: F.when(F.get(up, i)["child"] == i, F.get(up, i)).otherwise(first_of(up, lambda u: u["child"] == i))
    role = lambda u: F.coalesce(lookup(SYNTACTIC_ROLES, F.lower(F.coalesce(u["rel"], F.lit("")))), F.lit("unknown"))
    score = lambda x, r: F.round(F.least(F.lit(1.0), F.coalesce(lookup(POS_SCORES, x["pos"]), F.lit(0.3)) + F.coalesce(lookup(ROLE_BONUS, r), F.lit(0.0))), 4)
    row = lambda x, u, r: bound(score(x, r), lambda s: F.struct((-s).alias("minus"), x["start"].alias("start"), x["tok_idx"].alias("tok_idx"), x["text"].alias("text"), x["pos"].alias("pos"), r.alias("syntactic_role"), s.alias("score"), x["end"].alias("end"), u["rel"].alias("head_rel"), u["word"].alias("governing_verb")))
    rows = lambda t, up: F.transform(nouns(t), lambda x: bound(arc(up, x["tok_idx"]), lambda u: bound(role(u), lambda r: row(x, u, r))))
    found = bound(t, lambda t: bound(heads_of(F.col("deps"), t), lambda up: rows(t, up)))
    best = F.slice(F.array_sort(F.filter(found, lambda x: x["score"] >= least)), 1, most)
    ranked = F.transform(best, lambda x, i: F.struct((i + 1).alias("rank"), *[x[c].alias(c) for c in ("text", "pos", "syntactic_role", "score", "start", "end", "head_rel", "governing_verb")]))
    return each(docs.withColumn("__n", ranked), "__n", "n", "doc_id").select("doc_id", "n.*")


def events(relations: DataFrame) -> DataFrame:
    """Relations of one sentence, verb and subject are one event: rows (doc_id, event_id, sentence_index, trigger, agent,
    objects, relation_ids). Ids follow the order of sentence, verb and subject. Light verbs, relations of the classical patterns
and, where the columns are there, those of interrogative sentences are no events."""
    fine = relations.where("predicate_verb is not null and predicate_verb <> '' and subject <> object").where(~F.col("predicate_verb").isin(STOP_TRIGGERS))
    if "source" in relations.columns:
        fine = fine.where(~F.contains(F.coalesce("source", F.lit("")), F.lit("classical_pattern")))
    if "sentence_type" in relations.columns:
        fine = fine.where(F.coalesce("sentence_type", F.lit("")) != "interrogative")
    one = F.array_sort(F.collect_list(F.struct("rel_id", "object")))
    found = fine.groupBy("doc_id", "sentence_index", F.col("predicate_verb").alias("trigger"), F.col("subject").alias("agent")).agg(one.alias("r"))
    order = Window.partitionBy("doc_id").orderBy("sentence_index", "trigger", "agent")
    return found.select("doc_id", spans.numbered("evt", F.row_number().over(order)).alias("event_id"), "sentence_index", "trigger", "agent", F.col("r.object").alias("objects"), F.col("r.rel_id").alias("relation_ids"))


def events_in(relations: str, sentences: str) -> Column:
    """The events of an array of a document's relations (sentence_index, predicate_verb, subject, object), whose sentences are in
    another: structs (event_id, sentence_index, trigger, agent). Relations without a sentence make none."""
    known = lambda r: F.exists(sentences, lambda s: (s["sent_idx"] == r["sentence_index"]) & (F.coalesce(s["sentence_type"], F.lit("")) != "interrogative"))
    fine = F.filter(relations, lambda r: (r["predicate_verb"] != "") & (r["subject"] != r["object"]) & ~r["predicate_verb"].isin(STOP_TRIGGERS) & known(r))
    keys = F.array_sort(F.array_distinct(F.transform(fine, lambda r: F.struct(r["sentence_index"].alias("sentence_index"), r["predicate_verb"].alias("trigger"), r["subject"].alias("agent")))))
    return F.transform(keys, lambda k, i: F.struct(spans.numbered("evt", i + 1).alias("event_id"), k["sentence_index"].alias("sentence_index"), k["trigger"].alias("trigger"), k["agent"].alias("agent")))


def event_score(root: Column, agent: Column, patient: Column, longest: Column, mark: Column, disputed: Column, generic: Column) -> Column:
    on = lambda c, x: F.when(c, x).otherwise(0.0)
    score = F.lit(EVENT_BASE) + on(root, EVENT_ROOT) + on(agent, EVENT_AGENT) + on(patient, EVENT_PATIENT) - on(longest > LONG_ARGUMENT, EVENT_LONG) - on(mark, EVENT_MARK) - on(disputed, EVENT_DISPUTED) - on(generic, EVENT_GENERIC)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def event_confidence(events_: DataFrame, arguments: DataFrame) -> DataFrame:
    """Events (with is_root, predicate, semantic_class) with their confidence from their arguments (doc_id, event_id, role,
    text, disputed)."""
    other = F.col("role") != "Agent"
    a = arguments.groupBy("doc_id", "event_id").agg(
        F.max((~other & (F.length("text") > 0)).cast("int")).alias("agent_"), F.max((other & (F.length("text") > 0)).cast("int")).alias("patient_"), F.max(F.when(other, F.length("text"))).alias("longest_"),
        F.max((other & F.col("text").rlike("[。！？]")).cast("int")).alias("mark_"), F.max(F.coalesce("disputed", F.lit(False)).cast("int")).alias("disputed_"),
    )
    generic = (F.col("predicate") == "RELATES_TO") & F.col("semantic_class").isNull()
    score = event_score(F.col("is_root"), F.col("agent_") == 1, F.col("patient_") == 1, F.col("longest_"), F.col("mark_") == 1, F.col("disputed_") == 1, generic)
    return events_.join(a, ["doc_id", "event_id"], "left").withColumn("confidence", score).drop("agent_", "patient_", "longest_", "mark_", "disputed_")


def distinct_events(events_: DataFrame) -> DataFrame:
    """One event for each trigger span, agent and patient: the most confident, of equals the first."""
    order = Window.partitionBy("doc_id", "start", "end", F.coalesce("agent", F.lit("")), F.coalesce("patient", F.lit(""))).orderBy(F.col("confidence").desc(), "event_id")
    return events_.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def sub_events(events_: DataFrame) -> DataFrame:
    """Events (with has_agent) with is_main_event and sub_events: of one sentence and trigger, those with an agent are
    main; if none has, the most confident is."""
    group = Window.partitionBy("doc_id", "sentence_index", "trigger")
    rank = F.row_number().over(group.orderBy(F.col("confidence").desc(), "event_id"))
    any_agent = F.max(F.col("has_agent").cast("int")).over(group) == 1
    rows = events_.withColumn("__main", F.when(any_agent, F.col("has_agent")).otherwise(rank == 1))
    subs = F.collect_list(F.when(~F.col("__main"), F.col("event_id"))).over(group.orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("sub_events", F.when(F.col("__main"), subs).otherwise(F.array().cast("array<string>"))).withColumnRenamed("__main", "is_main_event")


def argument_roles(arguments: DataFrame, tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """Arguments (doc_id, arg_id, start, end) with the syntactic role and governing verb of the token they overlap most."""
    t = tokens.select("doc_id", "tok_idx", F.col("start").alias("ts"), F.col("end").alias("te"))
    shared = F.least("end", "te") - F.greatest("start", "ts")
    best = arguments.join(t, "doc_id").where(shared > 0).groupBy("doc_id", "arg_id").agg(F.max_by("tok_idx", F.struct(shared, -F.col("tok_idx"))).alias("tok_idx"))
    edges = deps.where("child >= 0").groupBy("doc_id", F.col("child").alias("tok_idx")).agg(F.max("rel").alias("rel"))
    found = best.join(edges, ["doc_id", "tok_idx"], "left").join(governing_verbs(deps, tokens), ["doc_id", "tok_idx"], "left")
    found = found.select("doc_id", "arg_id", lookup(SYNTACTIC_ROLES, F.lower(F.coalesce("rel", F.lit("")))).alias("syntactic_role"), "governing_verb")
    return arguments.join(found, ["doc_id", "arg_id"], "left")


def nearest_before(pronouns: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each pronoun (doc_id, mention_id, start, kind) the nearest anchor (doc_id, anchor_id, end, kind) of its kind that ends
    at or before it: the last one in order of place, so that no pairs are made."""
    a = anchors.where("end is not null").select("doc_id", "kind", F.col("anchor_id").alias("__anchor"), F.col("end").alias("__place"), F.lit(0).alias("__asks"))
    rows = a.unionByName(pronouns.withColumns({"__place": F.col("start"), "__asks": F.lit(1)}), allowMissingColumns=True)
    before = Window.partitionBy("doc_id", "kind").orderBy("__place", "__asks", "__anchor").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("anchor_id", F.last("__anchor", ignorenulls=True).over(before)).where("__asks = 1")
    # what is null belongs to nothing and stands nowhere
    fine = F.col("doc_id").isNotNull() & F.col("kind").isNotNull() & F.col("start").isNotNull()
    return found.withColumn("anchor_id", F.when(fine, F.col("anchor_id"))).select(*pronouns.columns, "anchor_id")


def chains(mentions: DataFrame) -> DataFrame:
    """Mentions of one text that occurs twice or more in a document: rows (doc_id, chain_id, representative, mentions, first)."""
    found = mentions.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("mentions"), F.min("start").alias("first")).where("mentions >= 2")
    order = Window.partitionBy("doc_id").orderBy("first", "text")
    return found.select("doc_id", spans.numbered("coref", F.row_number().over(order), 4).alias("chain_id"), F.col("text").alias("representative"), "mentions", "first")


def acceptable(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """Rows (doc_id, ok): false without tokens, with more than 60 % proper nouns, or with more than 70 % of over three
    arcs called root or dep."""
    t = tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos").isin("NR", "NNP", "NNPS")).alias("names"))
    d = deps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("arcs"), F.count_if(F.lower("rel").isin("root", "dep")).alias("guessed"))
    guess = (F.coalesce("arcs", F.lit(0)) > 3) & (F.col("guessed") > F.col("arcs") * 0.7)
    return t.join(d, "doc_id", "left").select("doc_id", ((F.col("names") <= F.col("n") * 0.6) & ~F.coalesce(guess, F.lit(False))).alias("ok"))


def crossing_arcs(deps: DataFrame) -> DataFrame:
    """Pairs of arcs that cross: a document (or sentence) without any is projective."""
    a = deps.where("head >= 0").select("doc_id", F.least("child", "head").alias("a1"), F.greatest("child", "head").alias("a2"))
    b = a.select("doc_id", F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    return a.join(b, "doc_id").where("a1 < b1 and b1 < a2 and a2 < b2")
