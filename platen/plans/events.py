"""Queries on event streams, artifacts, sources and golden values."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from platen.functions.expr import tidy
from platen.operators import audit
from platen.plans.register import query
from platen.sources import images, scans
from platen.sources.checkpoints import checkpointed
from platen.streaming import keyed, state

T6 = "floor(({}) * 1e6 + 0.5) / 1e6"


@query("st1_session_ttl", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc_id ORDER BY ts) <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM touches),
 s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT doc_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS touches FROM s GROUP BY doc_id, n""")
def _(v):
    s = state.sessions(v("touches"))
    return s.select("doc_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "touches")


_HELD = "h AS (SELECT user_id AS doc_id, event_id, cast(ts AS timestamp) AS ts, event_id % 3 = 0 AS inserted FROM events)"


@query("st1_held_documents", f"""WITH {_HELD}, i AS (SELECT DISTINCT ts AS t FROM h WHERE inserted), p AS (SELECT h.*, h.ts + INTERVAL 60 MINUTE AS due FROM h), r AS (SELECT p.*, i.t AS reaped FROM p ASOF LEFT JOIN i ON p.due < i.t),
 g AS (SELECT *, coalesce(lag(reaped) OVER w <= ts, lag(ts) OVER w IS NULL) AS gone, lag(ts) OVER w IS NULL AS first, lead(ts) OVER w AS next FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY ts, event_id)),
 n AS (SELECT *, sum((inserted OR gone)::int) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM g)
 SELECT doc_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS touches, epoch_us(CASE WHEN last(next ORDER BY ts, event_id) IS NULL OR last(reaped ORDER BY ts, event_id) <= last(next ORDER BY ts, event_id) THEN last(reaped ORDER BY ts, event_id) END) AS reaped
 FROM n GROUP BY doc_id, part HAVING bool_or(inserted)""")
def _(v):
    """Every third event stores its user's document, the others open it."""
    e = v("events").select(F.col("user_id").alias("doc_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 == 0).alias("inserted"))
    return keyed.held_documents(e).select("doc_id", *(F.unix_micros(c).alias(c) for c in ("start", "last")), "touches", F.unix_micros("reaped").alias("reaped"))


@query("st2_latest_page_state", "SELECT run_id AS doc_id, key AS page, last(ms ORDER BY ts, event_id) AS ms, max_by(event_id, (ts, event_id)) AS event_id FROM progress GROUP BY 1, 2")
def _(v):
    p = v("progress").withColumnsRenamed({"run_id": "doc_id", "key": "page"})
    return state.latest_state(p, ["doc_id", "page"], ["ts", "event_id"]).select("doc_id", "page", "ms", "event_id")


@query("st3_timing_ewma", """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY run_id, key) AS n FROM progress),
 f AS (SELECT run_id, key, k, n, floor(ms + 0.5) AS ewma FROM o WHERE k = 1 UNION ALL SELECT o.run_id, o.key, o.k, o.n, CASE WHEN f.ewma = 0 THEN floor(o.ms + 0.5) ELSE floor(0.5 * f.ewma + 0.5 * o.ms + 0.5) END FROM f JOIN o ON o.run_id = f.run_id AND o.key = f.key AND o.k = f.k + 1)
 SELECT run_id, key, ewma FROM f WHERE k = n""")
def _(v):
    return keyed.timing_ewma(v("progress"))


@query("st4_transfer_rate", f"""WITH l AS (SELECT run_id, event_id, ts, ms AS loaded, 500.0::double AS total, first_value(ts) OVER r AS t0, first_value(ms) OVER r AS b0 FROM progress WINDOW r AS (PARTITION BY run_id ORDER BY ts, event_id)),
 e AS (SELECT *, (epoch_us(ts) - epoch_us(t0)) / 1e6 AS s FROM l), q AS (SELECT *, CASE WHEN s > 0.8 AND loaded > b0 THEN (loaded - b0) / s END AS r FROM e)
 SELECT run_id, event_id, {T6.format('r * 1e3')} AS rate, CASE WHEN r IS NOT NULL THEN floor((total - loaded) / r + 0.5) END AS eta FROM q""")
def _(v):
    l = state.transfer_rate(v("progress").withColumn("loaded", F.col("ms")).withColumn("total", F.lit(500.0)))  # noqa: E741
    return l.select("run_id", "event_id", tidy(F.col("rate") * 1e3).alias("rate"), F.floor(F.col("eta") + 0.5).cast("double").alias("eta"))


@query("st5_step_state", """WITH RECURSIVE o AS (SELECT run_id, event_id % 5 AS step, event_id % 11 = 0 AS failed, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM progress),
 f AS (SELECT run_id, 0::bigint AS k, n, ['pending', 'pending', 'pending', 'pending', 'pending'] AS s FROM o WHERE k = 1 UNION ALL
 SELECT o.run_id, o.k, o.n, CASE WHEN o.failed THEN list_transform(f.s, lambda old: CASE WHEN old = 'active' THEN 'failed' ELSE old END) WHEN f.s[o.step + 1] = 'pending' THEN
 list_transform(f.s, lambda old, i: CASE WHEN i = o.step + 1 THEN 'active' WHEN i <= o.step AND old = 'pending' THEN 'dropped' WHEN i <= o.step AND old = 'active' THEN 'done' ELSE old END) ELSE f.s END
 FROM f JOIN o ON o.run_id = f.run_id AND o.k = f.k + 1) SELECT run_id, (generate_subscripts(s, 1) - 1)::int AS step, unnest(s) AS state FROM f WHERE k = n""")
def _(v):
    p = v("progress").withColumn("step", (F.col("event_id") % 5).cast("int")).withColumn("failed", F.col("event_id") % 11 == 0)
    return keyed.step_state(p, 5)


@query("st6_progress_fraction", f"SELECT event_id, {T6.format('CASE WHEN ms / 250 <= 1 THEN 0.9 * (ms / 250) ELSE 0.9 + 0.09 * (1 - exp(-(ms / 250 - 1))) END')} AS fraction FROM progress")
def _(v):
    return v("progress").select("event_id", tidy(state.progress_fraction(F.col("ms") / 250)).alias("fraction"))


@query("st7_combined_bytes", "SELECT run_id, sum((ms * 100)::bigint)::bigint AS loaded, (count(*) * 60000)::bigint AS total, bool_and(event_id % 4 <> 0) AS all_cached FROM progress GROUP BY run_id")
def _(v):
    return state.combined_bytes(v("progress").select("run_id", F.round(F.col("ms") * 100).cast("long").alias("loaded"), F.lit(60000).cast("long").alias("total"), (F.col("event_id") % 4 != 0).alias("from_cache")))


@query("st8_stale_result_filter", "WITH g AS (SELECT run_id, event_id, event_id % 7 AS generation FROM progress) SELECT run_id, event_id FROM g WHERE generation = (SELECT max(generation) FROM g h WHERE h.run_id = g.run_id)")
def _(v):
    return state.drop_stale(v("progress").select("run_id", "event_id", (F.col("event_id") % 7).alias("generation"))).select("run_id", "event_id")


@query("st9_debounce", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM progress),
 s AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT run_id, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS events FROM s GROUP BY run_id, n""")
def _(v):
    """The events of the test tables are minutes apart, so bursts here are of half an hour."""
    return state.debounce(v("progress"), "30 minutes")


@query("st10_signature_dedup", "SELECT min(scan_id * 1000 + cand_id) AS item FROM candidates GROUP BY scan_id % 50, floor(cx * 1e4 + 0.5), floor(cy * 1e4 + 0.5), floor(angle * 1e1 + 0.5)")
def _(v):
    c = v("candidates").select((F.col("scan_id") * 1000 + F.col("cand_id")).alias("item"), (F.col("scan_id") % 50).alias("page"), "cx", "cy", "angle")
    return state.signature_dedup(c, ["page"], {"cx": 4, "cy": 4, "angle": 1}, "item").select("item")


@query("st11_encode_once", "SELECT doc_id, md5(coalesce(text, '')) AS code FROM documents")
def _(v):
    d = v("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("digest"))
    return state.encode_once(d, lambda x: x.withColumn("code", F.md5("digest"))).select("doc_id", "code")


@query("st12_edit_invalidation", """WITH e AS (SELECT run_id AS page_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'fit' WHEN 1 THEN 'crop' WHEN 2 THEN 'items' WHEN 3 THEN 'tilt' ELSE 'turn' END AS kind FROM progress),
 l AS (SELECT page_id, max(CASE WHEN kind = 'fit' THEN (ts, event_id) END) AS f, max(CASE WHEN kind IN ('crop', 'tilt') THEN (ts, event_id) END) AS nf, max(CASE WHEN kind = 'items' THEN (ts, event_id) END) AS i, max(CASE WHEN kind IN ('tilt', 'turn') THEN (ts, event_id) END) AS ni FROM e GROUP BY page_id)
 SELECT page_id, f IS NOT NULL AND (nf IS NULL OR f > nf) AS fit_valid, i IS NOT NULL AND (ni IS NULL OR i > ni) AS items_valid FROM l""")
def _(v):
    k = F.col("event_id") % 5
    e = v("progress").select(F.col("run_id").alias("page_id"), "ts", "event_id", F.when(k == 0, "fit").when(k == 1, "crop").when(k == 2, "items").when(k == 3, "tilt").otherwise("turn").alias("kind"))
    return state.edit_invalidation(e)


@query("st13_format_progress", """SELECT event_id, format('{:d} s, ', floor(ms * 100 / 1000 + 0.5)::bigint) || CASE WHEN event_id * 40000 / 1e6 >= 10 THEN format('{:.0f} MB', floor(event_id * 40000 / 1e6 + 0.5)) ELSE format('{:.1f} MB', floor(event_id * 40000 / 1e6 * 10 + 0.5) / 10) END AS text FROM progress""")
def _(v):
    return v("progress").select("event_id", state.progress_text(F.col("ms") * 100, F.col("event_id") * 40000).alias("text"))


_AUDIT = r"""a AS (SELECT coalesce(m.name, o.name) AS name, m.bytes AS expected, o.bytes AS found FROM manifest m FULL JOIN observed o ON m.name = o.name)"""


@query("au1_artifact_audit", f"""WITH {_AUDIT} SELECT name, CASE WHEN expected IS NULL OR NOT regexp_matches(name, '(?i)^[a-z0-9][a-z0-9_.-]*\\.onnx(_data)?$') OR contains(name, '..') THEN 'unexpected' WHEN found IS NULL THEN 'missing'
 WHEN found > 536870912 THEN 'oversized' WHEN found <> expected THEN 'truncated' ELSE 'ok' END AS state FROM a""")
def _(v):
    return audit.artifact_audit(v("manifest"), v("observed"))


_COUNTS = "counts AS (SELECT quality, precision_, count(o.name) AS have, count(*) AS \"of\" FROM manifest m LEFT JOIN (SELECT DISTINCT name FROM observed) o ON o.name = m.name GROUP BY ALL)"


@query("au2_cached_count", f"WITH {_COUNTS} SELECT * FROM counts")
def _(v):
    return audit.cached_count(v("manifest"), v("observed"))


@query("au2_missing_files", "SELECT name, bytes FROM manifest WHERE name NOT IN (SELECT name FROM observed)")
def _(v):
    return audit.missing_files(v("manifest"), v("observed")).select("name", "bytes")


@query("au3_prune", "SELECT name, bytes FROM observed WHERE name NOT IN (SELECT name FROM manifest)")
def _(v):
    return audit.prune(v("observed"), v("manifest"))


@query("au4_download_bytes", "SELECT quality, precision_, sum(bytes)::bigint AS bytes, count(*) AS files FROM manifest GROUP BY ROLLUP (quality, precision_)")
def _(v):
    return audit.download_bytes(v("manifest"))


@query("au5_model_status", f"WITH {_COUNTS} SELECT quality, precision_, CASE WHEN quality = 'full' AND precision_ = 'fp16' THEN 'loaded' WHEN have = \"of\" THEN 'cached' WHEN have > 0 THEN have || ' of ' || \"of\" || ' cached' ELSE 'not downloaded' END AS status FROM counts")
def _(v):
    loaded = (F.col("quality") == "full") & (F.col("precision_") == "fp16")
    return audit.model_status(audit.cached_count(v("manifest"), v("observed")), loaded).select("quality", "precision_", "status")


@query("ev1_corpus_check", f"""WITH j AS (SELECT e.id, {T6.format('abs(m.w - e.expected_w)')} AS off_w, {T6.format('abs(m.h - e.expected_h)')} AS off_h, e.tolerance FROM corpus e JOIN measured m ON m.id = e.id)
 SELECT id, off_w, off_h, off_w <= tolerance AND off_h <= tolerance AS ok FROM j""")
def _(v):
    return audit.corpus_check(v("corpus"), v("measured"))


@query("ev2_page_geometry_check", "SELECT scan_id, abs(floor(page_w_pt / 72 * 25.4::double * 10 + 0.5) / 10 - page_w_pt * 25.4::double / 72) <= 0.04 AS ok FROM scans")
def _(v):
    s = v("scans").select("scan_id", (F.floor(F.col("page_w_pt") / 72 * 25.4 * 10 + 0.5) / 10).alias("w_mm"), (F.col("page_w_pt") * 25.4 / 72).alias("expected_w"), F.lit(0.0).alias("h_mm"), F.lit(0.0).alias("expected_h"))
    return audit.page_geometry_check(s, 0.04).select("scan_id", "ok")


_ERR = "e AS (SELECT floor(abs(m.w - e.expected_w) * 1e6 + 0.5) / 1e6 AS error FROM corpus e JOIN measured m ON m.id = e.id)"


@query("ev3_accuracy_summary", f"WITH {_ERR} SELECT quantile_cont(error, 0.5) AS median_error, max(error) AS worst, avg((error <= 2)::int) AS share_within_2 FROM e")
def _(v):
    return audit.accuracy_summary(audit.corpus_check(v("corpus"), v("measured")).withColumnRenamed("off_w", "error"))


@query("ev4_resolution_invariance", f"WITH m AS (SELECT id % 97 AS doc_id, w FROM measured) SELECT doc_id, {T6.format('max(w) - min(w)')} AS spread, max(w) - min(w) < 1 AS ok FROM m GROUP BY doc_id")
def _(v):
    m = v("measured").select((F.col("id") % 97).alias("doc_id"), F.col("w").alias("w_mm"))
    return audit.resolution_spread(m).withColumn("spread", tidy("spread"))


@query("ev5_kind_matrix", "SELECT side, kind, count(*) AS n FROM (SELECT side, (CASE WHEN ok THEN 2 ELSE 0 END + (abs(off) > 5)::int)::int AS kind FROM edge_samples) GROUP BY CUBE (side, kind)")
def _(v):
    return audit.kind_matrix(v("edge_samples").select("side", (F.when(F.col("ok"), 2).otherwise(0) + (F.abs("off") > 5).cast("int")).alias("kind")))


@query("ev6_skip_missing", "SELECT id, CASE WHEN visibility = 'private' THEN 'skipped' ELSE 'error' END AS outcome FROM corpus WHERE id NOT IN (SELECT id FROM measured)")
def _(v):
    return audit.skip_missing(v("corpus"), v("measured"))


@query("src1_page_scan", "SELECT scan_id, CASE WHEN lower(name) LIKE '%.pdf' THEN 'pdf' ELSE 'raster' END AS kind, page >= 0 AND page < page_count AS accepted FROM scans")
def _(v):
    good, bad = scans.page_scan(v("scans"))
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False))).select("scan_id", "kind", "accepted")


@query("src2_image_scan", "SELECT scan_id, count(*) AS pixels, (max(y) + 1)::int AS height, sum(v * (y * 80 + x + 1))::bigint AS checksum FROM (SELECT *, count(*) OVER (PARTITION BY scan_id, y) AS n FROM pixels) WHERE n = 80 GROUP BY 1")
def _(v):
    """Each document's text as a grey image, written as a file to the shared folder and read again by the image source."""
    folder = f"{checkpointed(v.spark)}/images-{uuid4().hex}"
    images.register(v.spark)
    images.packed_pixels(v("pixel_runs"), "scan_id", 80).write.format(images.NAME).mode("append").save(folder)
    read = images.image_scan(v.spark, folder).withColumn("scan_id", F.regexp_extract("name", r"(\d+)\.png$", 1).cast("long"))
    p = images.as_pixels(read, "scan_id")
    return p.groupBy("scan_id").agg(F.count("*").alias("pixels"), (F.max("y") + 1).alias("height"), F.sum(F.col("r") * (F.col("y") * 80 + F.col("x") + 1)).alias("checksum"))


_GOLDEN = "SELECT p_partkey AS id, 100 + p_size * 2.5::double AS w, 80 + p_partkey % 50::double AS h, (p_partkey % 11 - 5) * 0.3::double AS skew FROM part"


@query("src5_read_corpus", f"SELECT 'f' || id AS id, CASE WHEN id % 4 = 0 THEN 'private' ELSE 'public' END AS visibility, 300 AS render_dpi, w AS page_w_mm, h AS page_h_mm, skew FROM ({_GOLDEN})")
def _(v):
    """Golden values of all parts, written as sixteen corpus files and read again."""
    k, size = F.col("p_partkey"), F.col("p_size")
    expected = F.struct(((k % 11 - 5) * 0.3).alias("skew_degrees"))
    f = F.struct(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.when(k % 4 == 0, "private").otherwise("public").alias("visibility"), F.array(100 + size * 2.5, (80 + k % 50).cast("double")).alias("page_mm"), expected.alias("expected"))
    files = v.spark.read.parquet(f"{v.sf_dir}/part.parquet").groupBy((k % 16).alias("file")).agg(F.collect_list(f).alias("fixtures"))
    folder = f"{checkpointed(v.spark)}/corpus-{uuid4().hex}"
    files.select("file", F.lit(1).alias("version"), F.lit(300).alias("render_dpi"), F.lit("m").alias("model"), "fixtures").write.partitionBy("file").json(folder)
    return scans.read_corpus(v.spark, folder).select("id", "visibility", "render_dpi", "page_w_mm", "page_h_mm", F.col("expected.skew_degrees").alias("skew"))


@query("src3_oversize_filter", "SELECT name, bytes FROM manifest WHERE bytes * 2000 <= 60 * 1024 * 1024")
def _(v):
    return scans.within_size(v("manifest").withColumn("length", F.col("bytes") * 2000)).select("name", "bytes")


@query("src4_content_digest", "SELECT doc_id AS id, sha256(text) AS digest FROM documents WHERE doc_id % 13 = 5")
def _(v):
    """Every thirteenth recorded digest is of something else."""
    d = v("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    recorded = d.select("id", F.when(F.col("id") % 13 == 5, "0").otherwise(F.sha2(F.col("content").cast("binary"), 256)).alias("sha256"))
    return audit.digest_mismatches(d, recorded)


@query("src7_prompt_grid", "SELECT scan_id, i.i * 8 + j.j AS prompt_id, (i.i + 0.5::double) / 8 AS py, (j.j + 0.5::double) / 8 AS px FROM scans, range(8) i(i), range(8) j(j)")
def _(v):
    return scans.with_prompts(v("scans").select("scan_id"), scans.prompt_grid(v.spark, 8))


@query("src8_vote_prompts", """WITH p AS (SELECT 0 AS prompt_id, 'box' AS kind, 0.1::double AS x0, 0.1::double AS y0, 0.9::double AS x1, 0.9::double AS y1 UNION ALL SELECT 1, 'box', 0.2, 0.2, 0.8, 0.8
 UNION ALL SELECT (2 + i * 3 + j)::int, 'point', (j + 0.5::double) / 3, (i + 0.5::double) / 3, NULL, NULL FROM range(3) a(i), range(3) b(j)) SELECT scan_id, p.* FROM scans, p""")
def _(v):
    return scans.with_prompts(v("scans").select("scan_id"), scans.vote_prompts(v.spark))


@query("src9_normalise_features", f"SELECT scan_id, y, x, {T6.format('(v / 255.0::double - 0.485) / 0.229')} AS r, {T6.format('(v / 255.0::double - 0.456) / 0.224')} AS g, {T6.format('(v / 255.0::double - 0.406) / 0.225')} AS b FROM pixels")
def _(v):
    p = v("pixels").select("scan_id", "y", "x", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))
    return scans.normalised(p).select("scan_id", "y", "x", *(tidy(c).alias(c) for c in "rgb"))


@query("src6_proposals_scan", "SELECT m.mask_id, count(c.y) AS n, min(c.y * 1000 + c.x) // 1000 AS first_y, min(c.y * 1000 + c.x) % 1000 AS first_x FROM masks m LEFT JOIN mask_cells c ON c.mask_id = m.mask_id GROUP BY 1")
def _(v):
    p = scans.proposals_scan(v("masks").select("mask_id"), v("mask_cells"))
    first = F.try_element_at("cells", F.lit(1))
    return p.select("mask_id", F.coalesce(F.size("cells"), F.lit(0)).cast("long").alias("n"), first["y"].cast("long").alias("first_y"), first["x"].cast("long").alias("first_x"))


@query("src_scaled_prompts", "SELECT scan_id, i.i * 8 + j.j AS prompt_id, (j.j + 0.5::double) / 8 * 1024 AS mx, (i.i + 0.5::double) / 8 * 1024 AS my FROM scans, range(8) i(i), range(8) j(j)")
def _(v):
    return scans.scaled_prompts(scans.with_prompts(v("scans").select("scan_id"), scans.prompt_grid(v.spark, 8))).select("scan_id", "prompt_id", "mx", "my")
