"""Queries on registry tables, review tasks and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import lifecycle as lc
from cuelake.operators import lineage
from cuelake.plans import views as v
from cuelake.plans.registry import REG


def orders(spark, d):
    o = v.table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"),
                    F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


Q_O = "r_o AS (SELECT o_custkey AS media, o_orderkey AS id, o_orderpriority AS kind, o_orderdate AS created_at, o_orderstatus AS status, o_totalprice AS price FROM orders)"


@REG.query(f"WITH {Q_O} SELECT media, kind, id, price FROM (SELECT *, row_number() OVER (PARTITION BY media, kind ORDER BY created_at DESC, id DESC) AS rn FROM r_o) WHERE rn = 1")
def latest_per_key(spark, d):
    return lc.latest(orders(spark, d), ["media", "kind"], ["created_at", "id"]).select("media", "kind", "id", "price")


@REG.query(f"""WITH {Q_O} SELECT media, arg_max(kind, struct_pack(a := created_at, b := id)) AS file_path, strftime(min(created_at), '%Y-%m-%d') AS created_at,
  strftime(max(created_at), '%Y-%m-%d') AS updated_at FROM r_o GROUP BY media""")
def upsert_media(spark, d):
    w = orders(spark, d).select("media", F.col("kind").alias("file_path"), F.col("created_at").alias("ts"), F.col("id").alias("ord"))
    out = lc.upsert_media(w, "media")
    return out.select("media", "file_path", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("created_at", "updated_at")])


@REG.query(f"WITH {Q_O} SELECT id, 'invalid status: ' || status AS reason FROM r_o WHERE status NOT IN ('F', 'O')")
def append_with_domain_check(spark, d):
    return lc.check_domain(orders(spark, d), "status", ("F", "O"))[1].select("id", "reason")


@REG.query("""WITH i AS (SELECT event_id AS ord, event_id % 700 AS run_id FROM events), e AS (SELECT DISTINCT event_id % 300 AS run_id FROM events WHERE event_id % 2 = 0)
  SELECT ord, run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS rn FROM i) WHERE rn = 1 AND run_id NOT IN (SELECT run_id FROM e)""")
def unique_run_append(spark, d):
    e = v.table(spark, d, "events")
    inc = e.select(F.col("event_id").alias("ord"), (F.col("event_id") % 700).alias("run_id"))
    old = e.filter("event_id % 2 = 0").select((F.col("event_id") % 300).alias("run_id"))
    return lc.unique_append(old, inc, "run_id", "ord")[0]


Q_ST = """
t_ent AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 10 <> 3),
t_ev AS (SELECT user_id AS id, event_id AS ord, CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'rejected' WHEN 'error' THEN 'reprocess' WHEN 'signup' THEN 'pending' ELSE 'bogus' END AS status FROM events)"""


def status_events(spark, d):
    e = v.table(spark, d, "events")
    t = F.col("event_type")
    st = F.when(t == "click", "approved").when(t == "view", "rejected").when(t == "error", "reprocess").when(t == "signup", "pending").otherwise("bogus")
    ents = e.select(F.col("user_id").alias("id")).distinct().filter("id % 10 <> 3").withColumn("status", F.lit("pending"))
    return ents, e.select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), st.alias("status"))


@REG.query(f"""WITH {Q_ST} SELECT e.id, coalesce(arg_max(v.status, v.ord), 'pending') AS status FROM t_ent e LEFT JOIN t_ev v ON v.id = e.id AND v.status <> 'bogus' GROUP BY e.id""")
def update_status(spark, d):
    return lc.apply_status(*status_events(spark, d), "id", lc.REVIEW_STATUS, ["ord"])[0]


@REG.query(f"WITH {Q_ST} SELECT id, ord, CASE WHEN status = 'bogus' THEN 'invalid status: bogus' ELSE 'unknown id' END AS reason FROM t_ev WHERE status = 'bogus' OR id NOT IN (SELECT id FROM t_ent)")
def status_rejects(spark, d):
    return lc.apply_status(*status_events(spark, d), "id", lc.REVIEW_STATUS, ["ord"])[1].select("id", "ord", "reason")


@REG.query("SELECT user_id AS task_id, event_id AS ord, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def append_history(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("action"),
                                           F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return lc.review_history(e, "task_id", "us", "ord").select("task_id", "ord", "action", "seq")


@REG.query(f"WITH {Q_O} SELECT id, media, status FROM r_o ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_runs(spark, d):
    return lc.recent_runs(orders(spark, d)).select("id", "media", "status")


@REG.query(f"WITH {Q_O} SELECT id, media FROM r_o WHERE status = 'P' ORDER BY created_at, id")
def review_queue(spark, d):
    return lc.review_queue(orders(spark, d), "P").select("id", "media")


@REG.query("""SELECT o_orderkey AS id, CASE WHEN max(l_shipdate) > any_value(o_orderdate) THEN 'skipped' ELSE 'todo' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def skip_processed(spark, d):
    i = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("mtime"))
    o = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("mtime"))
    return lc.skip_processed(i, o, "id").select("id", "status")


@REG.query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def processed_titles(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return lc.with_output(o, v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@REG.query("""WITH s AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'skipped' WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ok' END ELSE 'no_change' END AS status FROM events)
  SELECT user_id, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'no_change') AS no_change,
    count(*) FILTER (status = 'failed') AS failed, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 1 WHEN count(*) FILTER (status = 'no_change') > 0 THEN 2 ELSE 0 END AS exit_code FROM s GROUP BY ALL""")
def run_status_counts(spark, d):
    t = F.col("event_type")
    st = F.when(t == "click", "ok").when(t == "view", "skipped").when(t == "error", F.when(F.col("event_id") % 5 == 0, "failed").otherwise("ok")).otherwise("no_change")
    return lc.run_status_counts(v.table(spark, d, "events").select("user_id", st.alias("status")), ["user_id"])


@REG.query(f"WITH {Q_O} SELECT t.event_id AS task_id, o.id AS candidate_id, o.media FROM events t JOIN r_o o ON o.id = t.event_id % 5000 WHERE t.event_type = 'error'")
def reprocess_candidates(spark, d):
    t = v.table(spark, d, "events").select(F.col("event_id").alias("task_id"), (F.col("event_id") % 5000).alias("candidate_id"),
                                           F.when(F.col("event_type") == "error", "reprocess").otherwise("pending").alias("status"))
    c = orders(spark, d).select(F.col("id").alias("candidate_id"), "media")
    return lc.reprocess_candidates(t, c).select("task_id", "candidate_id", "media")


Q_TASK = """
p_r AS (SELECT user_id AS media, event_id % 400 AS candidate_id, event_id AS ord FROM events WHERE event_type IN ('error', 'view')),
p_o AS (SELECT DISTINCT user_id AS media, event_id % 400 AS candidate_id FROM events WHERE event_type = 'click')"""


@REG.query(f"WITH {Q_TASK} SELECT media, candidate_id, min(ord) AS ord FROM p_r WHERE NOT EXISTS (SELECT 1 FROM p_o WHERE p_o.media = p_r.media AND p_o.candidate_id = p_r.candidate_id) GROUP BY ALL")
def create_tasks(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id").alias("media"), (F.col("event_id") % 400).alias("candidate_id"), F.col("event_id").alias("ord"), "event_type")
    routed = e.filter(F.col("event_type").isin("error", "view")).drop("event_type")
    pending = e.filter("event_type = 'click'").select("media", "candidate_id", F.lit("pending").alias("status"))
    return lc.create_tasks(routed, pending).select("media", "candidate_id", "ord")


@REG.query(f"""WITH {Q_O}, p AS (SELECT id AS prio, media, 's' || (id % 7) AS source_id FROM r_o WHERE id % 4 = 0), c AS (SELECT media, id, 's' || (id % 11) AS source_id FROM r_o),
  b AS (SELECT media, source_id, max(id) AS id FROM c GROUP BY ALL), h AS (SELECT p.media, arg_min(b.id, p.prio) AS hit FROM p JOIN b USING (media, source_id) GROUP BY ALL)
  SELECT l.media, coalesce(h.hit, l.id) AS candidate_id, h.hit IS NOT NULL AS by_preference FROM (SELECT media, max(id) AS id FROM c GROUP BY media) l LEFT JOIN h USING (media)""")
def resolve_review_candidate(spark, d):
    o = orders(spark, d)
    sid = lambda n: F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("source_id")
    return lc.resolve_candidate(o.filter("id % 4 = 0").select("media", F.col("id").alias("prio"), sid(7)), o.select("media", "id", sid(11)))


@REG.query(f"""WITH {Q_O}, c AS (SELECT media, id, CASE WHEN id % 3 = 0 THEN id - 3 END AS parent_id FROM r_o)
  SELECT c.id AS task_id, c.media, c.id AS candidate_id, coalesce(n.id, p.id, (SELECT max(s.id) FROM c s WHERE s.media = c.media AND s.id <> c.id)) AS compare_candidate_id
  FROM c LEFT JOIN c n ON n.id = CASE WHEN c.id % 5 = 0 THEN c.id + 1 END LEFT JOIN c p ON p.id = c.parent_id""")
def choose_compare_track(spark, d):
    o = orders(spark, d).select("media", "id", F.when(F.col("id") % 3 == 0, F.col("id") - 3).alias("parent_id"))
    tasks = o.select(F.col("id").alias("task_id"), "media", F.col("id").alias("candidate_id"), F.when(F.col("id") % 5 == 0, F.col("id") + 1).alias("compare_id"))
    return lc.choose_compare(tasks, o)


# --- review edits over the dialogue tracks ----------------------------------------------

Q_EDIT = v.Q_DIALOGUE + """,
e_ed AS (SELECT media, cand, CASE WHEN (media + idx) % 7 = 0 THEN idx + 100 ELSE idx END AS idx, CASE WHEN (media + idx) % 2 = 0 THEN text ELSE 'fixed ' || text END AS new_text
  FROM v_dialogue WHERE (media + idx) % 3 = 0),
e_all AS (SELECT d.*, coalesce(e.new_text, d.text) AS after, e.new_text IS NOT NULL AS edited FROM v_dialogue d LEFT JOIN e_ed e USING (media, cand, idx))"""


def edits(spark, d):
    k = F.col("media") + F.col("idx")
    c = v.dialogue(spark, d)
    e = c.filter(k % 3 == 0).select("media", "cand", F.when(k % 7 == 0, F.col("idx") + 100).otherwise(F.col("idx")).alias("idx"),
                                    F.when(k % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("fixed "), "text")).alias("new_text"))
    return c, e


@REG.query(f"WITH {Q_EDIT} SELECT media, cand, idx, after AS text, edited FROM e_all")
def apply_edits(spark, d):
    return lc.apply_edits(*edits(spark, d), v.TRACK)[0].select(*v.TRACK, "idx", "text", "edited")


@REG.query(f"WITH {Q_EDIT} SELECT media, cand, idx FROM e_ed e WHERE NOT EXISTS (SELECT 1 FROM v_dialogue d WHERE d.media = e.media AND d.idx = e.idx)")
def edits_out_of_range(spark, d):
    return lc.apply_edits(*edits(spark, d), v.TRACK)[1].select(*v.TRACK, "idx")


@REG.query(f"""WITH {Q_EDIT}, w AS (SELECT *, coalesce(lag(trim(role)) OVER (PARTITION BY media ORDER BY idx), '') AS previous_context,
    coalesce(lead(trim(role)) OVER (PARTITION BY media ORDER BY idx), '') AS next_context FROM e_all)
  SELECT media, cand, idx, trim(role) AS source_text, {v.sql_strip('text')} AS bad_translation, {v.sql_strip('after')} AS approved_translation, previous_context, next_context
  FROM w WHERE edited AND {v.sql_strip('text')} <> {v.sql_strip('after')} AND {v.sql_strip('text')} <> ''""")
def corrections_from_edits(spark, d):
    e = lc.apply_edits(*edits(spark, d), v.TRACK)[0]
    return lc.corrections_from_edits(e, v.TRACK, "role").drop("tags")


@REG.query(f"""WITH {Q_EDIT}, n AS (SELECT media, count(*) AS n FROM e_ed GROUP BY media)
  SELECT m AS task_id, m AS media, 'dialogue.review_t' || m AS source_id, 'accepted' AS candidate_status, 'approved' AS task_status, coalesce(n.n, 0) AS edit_count
  FROM (SELECT DISTINCT media AS m FROM v_dialogue WHERE media % 2 = 0) LEFT JOIN n ON n.media = m""")
def approve_tasks(spark, d):
    c, e = edits(spark, d)
    tasks = c.filter("media % 2 = 0").select("media").distinct().select(F.col("media").alias("task_id"), "media", F.col("media").alias("candidate_id"),
                                                                        F.lit("dialogue").alias("source_id"))
    return lc.approve_tasks(tasks, e).select("task_id", "media", "source_id", "candidate_status", "task_status", "edit_count")


@REG.query("SELECT DISTINCT conv_id AS task_id, 'rejected' AS task_status, 'task_rejected' AS action, 'conv ' || conv_id AS reviewer_notes FROM conversations WHERE conv_id % 2 = 1")
def reject_tasks(spark, d):
    t = v.table(spark, d, "conversations").filter("conv_id % 2 = 1").select(F.col("conv_id").alias("task_id")).distinct()
    return lc.reject_tasks(t, F.concat(F.lit("conv "), F.col("task_id").cast("string")))


# --- lineage ---------------------------------------------------------------------------

Q_LIN = """
l_n AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent_id, conv_id, turn,
  CASE WHEN turn % 3 = 0 THEN role END AS asr_status FROM conversations)"""


def nodes(spark, d):
    c = v.table(spark, d, "conversations")
    i = F.col("conv_id") * 100 + F.col("turn")
    return c.select(i.alias("id"), F.when(F.col("turn") > 0, i - 1).alias("parent_id"), F.when(F.col("turn") % 3 == 0, F.col("role")).alias("asr_status"))


@REG.query(f"""WITH RECURSIVE {Q_LIN}, w AS (SELECT id, id AS ancestor, parent_id, 0 AS dist FROM l_n UNION ALL
    SELECT w.id, p.id, p.parent_id, w.dist + 1 FROM w JOIN l_n p ON p.id = w.parent_id)
  SELECT id, ancestor, CAST(max(dist) OVER (PARTITION BY id) - dist AS BIGINT) AS pos FROM w""")
def candidate_lineage(spark, d):
    return lineage.candidate_chain(nodes(spark, d))


@REG.query(f"""WITH {Q_LIN} SELECT id, coalesce(asr_status, last_value(asr_status IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn)) AS asr_status FROM l_n""")
def propagate_meta(spark, d):
    return lineage.propagate_meta(nodes(spark, d), ["asr_status"]).select("id", "asr_status")


@REG.query("""SELECT conv_id AS id, role, NULL AS source_language FROM conversations UNION ALL SELECT doc_id, source, lang FROM documents""")
def additive_schema(spark, d):
    old = v.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "role")
    new = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("role"), F.col("lang").alias("source_language"))
    return lc.union_tracks(old, new)
