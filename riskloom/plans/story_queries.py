"""Near-duplicates, stories, event signals and entity index over the document feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import corpus
from riskloom.functions.scan import Carry, hours, prefix_scan
from riskloom.operators import evaluate, gate, index, neardup, signals as sg, stories as st
from riskloom.plans.market_queries import calibration
from riskloom.plans.registry import big, query, r6, secs, staged
from riskloom.plans.text_queries import DIMS, FEED, FPSTOPS, HITS_SQL, LABEL_SQL, MENTION_SQL, SIG_SQL, TOKENS_SQL, VOICE_SQL, mention_rows
from riskloom.dims.text_rules import FINANCE

# (document, entity) rows with voice, denial flag and text keys, as the pipeline sees them
ROWS_SQL = f"""fbk AS (SELECT label.doc_id, 'MACRO:MARKET' AS ent FROM label WHERE cls IN ('MACROECONOMIC', 'GEOPOLITICAL') AND conf >= 0.5 AND doc_id NOT IN (SELECT doc_id FROM mention)),
allm AS (SELECT doc_id, ent FROM mention UNION ALL SELECT doc_id, ent FROM fbk),
dn AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: list_contains([{", ".join(f"'{w}'" for w in corpus.CORPUS_DENIALS)}], t))) > 0 AS says FROM feed_text),
off AS (SELECT * FROM (VALUES {", ".join(f"('{e.entity_id}', '{d}')" for e in corpus.ENTITIES for d in e.domains)}) t(ent, domain)),
mrow AS (SELECT a.doc_id, a.ent AS entity_id, f.t, f.source_type, v.vkey AS own_key, says AND NOT v.look AND (v.auth OR EXISTS (SELECT 1 FROM off WHERE off.ent = a.ent AND (regexp_replace(lower(f.publisher), '^www\\.', '') = domain OR ends_with(regexp_replace(lower(f.publisher), '^www\\.', ''), '.' || domain)))) AS denial
  FROM allm a JOIN feed f USING (doc_id) JOIN dn USING (doc_id) JOIN voice v ON v.publisher = f.publisher AND v.source_type = f.source_type AND v.author IS NOT DISTINCT FROM f.author)"""
BASE_SQL = f"{FEED}, {TOKENS_SQL}, {SIG_SQL}, {VOICE_SQL}, {LABEL_SQL}, {HITS_SQL}, {MENTION_SQL}, {ROWS_SQL}"
PAIRS_SQL = """base AS MATERIALIZED (SELECT mrow.*, cw, s FROM mrow JOIN sig USING (doc_id) WHERE NOT denial),
pr AS (SELECT b.entity_id, b.doc_id, b.own_key, b.source_type, a.doc_id AS a_doc, a.t AS a_t, a.own_key AS a_key, a.source_type AS a_type,
  len(list_filter(list_zip(b.s, a.s), lambda z: z[1] = z[2])) / 64.0 AS sim, CASE WHEN len(b.cw) = 0 OR len(a.cw) = 0 THEN 0.0 ELSE len(list_intersect(b.cw, a.cw)) / (len(b.cw) + len(a.cw) - len(list_intersect(b.cw, a.cw)))::DOUBLE END AS jac
  FROM base b JOIN base a ON a.entity_id = b.entity_id AND (a.t, a.doc_id) < (b.t, b.doc_id) AND b.t - a.t <= 86400)"""


def doc_rows(spark, sf):
    def build():
        rows = mention_rows(spark, sf).filter(~F.col("denial"))
        return neardup.earlier_similar(rows, DIMS)
    return staged(spark, sf, "similar", build)


@query("w01_novelty", f"WITH {BASE_SQL}, {PAIRS_SQL} SELECT base.doc_id, base.entity_id, count(*) FILTER (WHERE sim >= 0.5 OR jac >= 0.3) AS similar, round_even(100.0 / (1 + count(*) FILTER (WHERE sim >= 0.5 OR jac >= 0.3)), 0)::BIGINT AS novelty FROM base LEFT JOIN pr ON pr.doc_id = base.doc_id AND pr.entity_id = base.entity_id GROUP BY ALL")
def w01(spark, sf):
    """Novelty: 100 / (1 + earlier similar stories of the entity in 24 h) without document pairs."""
    return doc_rows(spark, sf).select("doc_id", "entity_id", big("similar").alias("similar"), big(neardup.novelty_of(F.col("similar"))).alias("novelty"))


@query("j08_copy_sources", f"""WITH {BASE_SQL}, {PAIRS_SQL}, bestn AS (SELECT entity_id, doc_id, arg_min(a_doc, (-sim, a_t, a_doc)) AS near_doc FROM pr WHERE sim >= 0.8 GROUP BY ALL) SELECT entity_id, doc_id, near_doc FROM bestn""")
def j08(spark, sf):
    """Most similar earlier document (>= 0.8) per document and entity."""
    return doc_rows(spark, sf).filter(F.col("near").isNotNull()).select("entity_id", "doc_id", F.col("near.near_doc").alias("near_doc"))


@query("f06_inherited_voices", f"""WITH RECURSIVE {BASE_SQL}, {PAIRS_SQL}, bestn AS MATERIALIZED (SELECT entity_id, doc_id, arg_min((a_doc, a_key, a_type), (-sim, a_t, a_doc)) AS n, any_value(source_type) AS st FROM pr WHERE sim >= 0.8 GROUP BY entity_id, doc_id),
 lk AS MATERIALIZED (SELECT entity_id, doc_id, n[1] AS parent, n[2] AS pkey FROM bestn WHERE st <> 'social' AND n[3] <> 'social'),
 walk AS (SELECT entity_id, doc_id, parent, pkey FROM lk UNION ALL SELECT w.entity_id, w.doc_id, l.parent, l.pkey FROM walk w JOIN lk l ON l.entity_id = w.entity_id AND l.doc_id = w.parent),
 root AS (SELECT entity_id, doc_id, pkey FROM walk w WHERE NOT EXISTS (SELECT 1 FROM lk l WHERE l.entity_id = w.entity_id AND l.doc_id = w.parent))
SELECT base.entity_id, base.doc_id, coalesce(root.pkey, own_key) AS voice, coalesce(root.pkey <> own_key, false)::BIGINT AS syndicated FROM base LEFT JOIN root USING (entity_id, doc_id)""")
def f06(spark, sf):
    """Independence keys after syndication: copies speak with the original's voice, followed to the root."""
    return neardup.with_voice(doc_rows(spark, sf)).select("entity_id", "doc_id", "voice", big(F.col("syndicated").cast("int")).alias("syndicated"))


@query("w02_fingerprint_novelty", f"""WITH {BASE_SQL}, fp AS (SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(CASE WHEN title <> '' THEN title ELSE body END), '[a-z0-9]+'), lambda t: NOT list_contains({FPSTOPS}, t))[1:10], ' ') AS fp FROM feed),
 b AS (SELECT mrow.*, fp FROM mrow JOIN fp USING (doc_id)) SELECT x.doc_id, x.entity_id, count(y.doc_id) AS repeats FROM b x LEFT JOIN b y ON y.entity_id = x.entity_id AND y.fp = x.fp AND (y.t, y.doc_id) < (x.t, x.doc_id) AND x.t - y.t <= 86400 GROUP BY ALL""")
def w02(spark, sf):
    m = mention_rows(spark, sf).select("entity_id", "doc_id", "published_at")
    f = corpus.feed(spark, sf).select("doc_id", "title", "body")
    return neardup.fingerprint_novelty(m.join(f, "doc_id"), FINANCE).select("doc_id", "entity_id", big("repeats").alias("repeats"))


# story chains without denials: the sequential rule, one document at a time
CHAIN_SQL = """seqd AS MATERIALIZED (SELECT entity_id, doc_id, t, cls, row_number() OVER (PARTITION BY entity_id ORDER BY t, doc_id) AS k FROM mrow JOIN label USING (doc_id) WHERE NOT denial),
fold AS (
  SELECT entity_id, k, doc_id, doc_id AS start_doc, [{'id': doc_id, 'cls': cls, 'seen': t}] AS open FROM seqd WHERE k = 1
  UNION ALL
  SELECT entity_id, k, doc_id, hit.id, list_prepend({'id': hit.id, 'cls': CASE WHEN cls = 'OTHER' THEN hit.cls ELSE cls END, 'seen': t}, list_filter(live, lambda o: o.id <> hit.id)) FROM (
    SELECT entity_id, k, doc_id, cls, t, live, coalesce(CASE WHEN cls = 'OTHER' THEN list_filter(live, lambda o: t - o.seen <= 21600)[1]
      ELSE coalesce(list_filter(live, lambda o: o.cls = cls)[1], list_filter(live, lambda o: o.cls = 'OTHER' AND t - o.seen <= 21600)[1]) END, {'id': doc_id, 'cls': cls, 'seen': t}) AS hit
    FROM (SELECT q.entity_id, q.k, q.doc_id, q.cls, q.t, list_filter(f.open, lambda o: q.t - o.seen <= 86400) AS live FROM fold f JOIN seqd q ON q.entity_id = f.entity_id AND q.k = f.k + 1)))"""


def undisputed(spark, sf):
    rows = mention_rows(spark, sf).filter(~F.col("denial")).select("entity_id", "published_at", "doc_id", F.col("label.primary").alias("event"))
    return staged(spark, sf, "chains", lambda: st.assign(rows, spark.createDataFrame([], st.RESET)))


@query("t08_story_chains", f"WITH RECURSIVE {BASE_SQL}, {CHAIN_SQL} SELECT entity_id, doc_id, start_doc FROM fold")
def t08(spark, sf):
    """Story assignment before denials: prefix scans against a document-by-document recursion in SQL."""
    return undisputed(spark, sf).select("entity_id", "doc_id", "start_doc")


def built(spark, sf) -> st.Stories:
    return staged(spark, sf, "stories", lambda: st.build_stories(mention_rows(spark, sf), DIMS))


def grouped(spark, sf):
    return staged(spark, sf, "groups", lambda: st.social_groups(built(spark, sf).members, DIMS))


def event_rows(spark, sf):
    return staged(spark, sf, "event_signals", lambda: sg.event_signals(built(spark, sf), grouped(spark, sf)))


@query("m02_stories")
def m02(spark, sf):
    """Stories with denials settled: member rows and the story they belong to."""
    return built(spark, sf).members.select("entity_id", "doc_id", "cluster_id", "slot", "voice", big("novelty").alias("novelty"), big("impact").alias("impact"))


@query("j09_denial_matches")
def j09(spark, sf):
    """Denials matched to the story they refer to, and whether they retract or contest it."""
    return built(spark, sf).denials.select("entity_id", "doc_id", "cluster_id", "kind")


@query("w18_repost_groups")
def w18(spark, sf):
    """Social repost groups inside stories."""
    g = grouped(spark, sf)
    posts = built(spark, sf).members.select("entity_id", "doc_id", "author")
    return g.join(posts, ["entity_id", "doc_id"]).groupBy("cluster_id", "group_id").agg(F.count("*").alias("posts"), F.count_distinct("author").alias("authors"))


def signal_columns(e):
    return e.select("signal_id", "cluster_id", secs("as_of").alias("at"), "event", F.coalesce("subtype", F.lit("")).alias("subtype"), "event_conf", "sentiment", "sent_conf",
                    big("impact").alias("impact"), big("publishers").alias("publishers"), big("publishers_60m").alias("publishers_60m"), big("social_authors").alias("social_authors"),
                    "status", F.concat_ws(",", "flags").alias("flags"))


@query("m03_event_signals")
def m03(spark, sf):
    """One re-scored event signal per story update."""
    return signal_columns(event_rows(spark, sf))


def calibrated_rows(spark, sf, model):
    """Stories and event signals scored by a fitted impact model."""
    stories = st.build_stories(mention_rows(spark, sf), DIMS, model)
    return sg.event_signals(stories, st.social_groups(stories.members, DIMS), model)


@query("m17_story_impacts")
def m17s(spark, sf):
    """Event signals with the impact model that the filing study fitted: impact and the chance of a large move."""
    model, _ = calibration(spark, sf)
    e = staged(spark, sf, "calibrated_signals", lambda: calibrated_rows(spark, sf, model))
    return e.select("signal_id", "cluster_id", "event", big("impact").alias("impact"), F.coalesce("p_large_move", F.lit(-1.0)).alias("p_large_move"), "status")


@query("w04_publishers_60m")
def w04(spark, sf):
    """Rolling distinct publishers of the last hour: how many updates have how many."""
    e = event_rows(spark, sf).filter("status = 'active'")
    return e.groupBy(big("publishers_60m").alias("publishers_60m")).agg(F.count("*").alias("n"))


@query("k03_story_evidence")
def k03(spark, sf):
    """Top-3 evidence per story by weight."""
    return sg.story_evidence(built(spark, sf).members).select("cluster_id", big("rank").alias("rank"), "doc_id", "weight")


@query("k05_latest_members")
def k05(spark, sf):
    """Latest member per story."""
    m = built(spark, sf).members
    return m.groupBy("cluster_id").agg(F.max_by("doc_id", F.struct("published_at", "doc_id")).alias("doc_id"), F.count("*").alias("members"))


@query("p21_confirmed_stories")
def p21(spark, sf):
    """Stories with three independent voices or one authoritative source."""
    m = built(spark, sf).members
    ok = F.when((F.col("source_type") != "social") & ~F.col("lookalike"), F.col("voice"))
    g = m.groupBy("cluster_id").agg(F.count_distinct(ok).alias("voices"), F.max((F.col("authoritative") & ~F.col("lookalike")).cast("int")).alias("auth"))
    return g.filter((F.col("voices") >= 3) | (F.col("auth") == 1)).select("cluster_id", "voices", big("auth").alias("auth"))


@query("a29_dedup_report")
def a29(spark, sf):
    """Documents and reports against stories and voices per language pack."""
    s = built(spark, sf)
    lang = corpus.feed(spark, sf).select("doc_id", F.col("language").alias("pack"))
    docs = s.members.join(lang, "doc_id")
    latest = evaluate.latest_by(event_rows(spark, sf), ["cluster_id"], "as_of").join(
        docs.select("cluster_id", "pack").groupBy("cluster_id").agg(F.min("pack").alias("pack")), "cluster_id")
    r = evaluate.dedup_report(docs, latest, "pack")
    return r.select("pack", *[big(c).alias(c) for c in ("documents", "reports", "posts", "outlets", "stories", "severe_stories", "max_publishers", "coordinated_groups")])


def numbered(spark, sf):
    """Document and event signals of a story in processing order (documents before the event they cause)."""
    def build():
        ev = event_rows(spark, sf).withColumn("_g", F.lit(1))
        dc = sg.document_signals(built(spark, sf)).filter("cluster_id is not null").withColumn("_g", F.lit(0))
        both = ev.unionByName(dc.drop("novelty", "flags", "span"), allowMissingColumns=True)
        return prefix_scan(both, ["entity_id"], ["as_of", "doc_id", "_g", "signal_id"], hours("as_of"), [Carry("seq", "sum", F.lit(1).cast("bigint"))])
    return staged(spark, sf, "numbered", build)


@query("m05_story_gate")
def m05s(spark, sf):
    """The trigger gate over the document pipeline's own event signals."""
    n = numbered(spark, sf)
    d = gate.evaluate(gate.with_last_document(n.filter("grain = 'event'"), n.filter("grain = 'document'")))
    return gate.changes(d).select("signal_id", "entity_id", "cluster_id", "decision", "naive_decision", F.coalesce("scenario", F.lit("")).alias("scenario"), "failed")


@query("m04_story_index")
def m04(spark, sf):
    """The decayed entity index over the document pipeline's event signals."""
    e = index.entity_index(numbered(spark, sf).filter("grain = 'event'"))
    return e.select("signal_id", "entity_id", r6("sentiment").alias("sentiment"), r6("sent_conf").alias("sent_conf"), big("impact").alias("impact"), "stories")


@query("m20_pack_scorecard")
def m20(spark, sf):
    """Gate scorecard of the document pipeline per language pack."""
    n = numbered(spark, sf)
    lang = corpus.feed(spark, sf).select("doc_id", F.col("language").alias("pack"))
    d = gate.evaluate(gate.with_last_document(n.filter("grain = 'event'"), n.filter("grain = 'document'")))
    log = gate.changes(d).join(lang, "doc_id").select("pack", "cluster_id", "decision", "as_of")
    docs = n.filter("grain = 'document'").join(lang, "doc_id").select("pack", "doc_id", "sentiment", "as_of")
    s = evaluate.gate_scorecard(log, docs, "pack")
    return s.select("pack", *[big(c).alias(c) for c in ("documents", "naive_fires", "triggers", "reviews", "retractions")])
