"""Model proposals: scores, overlaps, greedy groups and votes, alternatives, and answers found among them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.expr import containment, iou, settled

#: Groups of a scan up to which a candidate looks at all of them.
FEW = 32
MIN_SCORE, IOU, CONTAINED, MOST_GROUPS, SEED_IOU = 0.80, 0.45, 0.75, 16, 0.8


def score_filter(candidates: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    return candidates.where(F.col("score") >= least)


def cells_under(boxes: DataFrame, cells: int) -> DataFrame:
    """boxes once for each cell (gx, gy) of a cells x cells grid of the frame that they reach into; x0 and y0 are their first ones. What lies outside the frame counts to its rim."""
    at = lambda c, s, sign: F.least(F.greatest(F.floor((F.col(c) + sign * F.col(s) / 2) * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    b = settled(boxes, x0=at("cx", "w", -1), x1=at("cx", "w", 1), y0=at("cy", "h", -1), y1=at("cy", "h", 1))
    return b.withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1"))).drop("x1", "y1")


def overlap_pairs(candidates: DataFrame, cells: int = 4) -> DataFrame:
    """(scan_id, a, b, iou, containment) of every two overlapping candidates of a scan, a < b.

    Boxes meet in the cells of a grid that both reach into, and count in the first of these alone. cells: about what a usual box's side goes into the frame.
    """
    g = cells_under(candidates.select("scan_id", "cand_id", "cx", "cy", "w", "h"), cells)
    a, b = g.alias("a"), g.alias("b")
    meet = (F.col("a.scan_id") == F.col("b.scan_id")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.cand_id") < F.col("b.cand_id"))
    first = (F.col("a.gx") == F.greatest("a.x0", "b.x0")) & (F.col("a.gy") == F.greatest("a.y0", "b.y0"))
    near = (F.abs(F.col("a.cx") - F.col("b.cx")) < (F.col("a.w") + F.col("b.w")) / 2) & (F.abs(F.col("a.cy") - F.col("b.cy")) < (F.col("a.h") + F.col("b.h")) / 2)
    return a.join(b, meet & first & near).select("a.scan_id", F.col("a.cand_id").alias("a"), F.col("b.cand_id").alias("b"), iou("a", "b").alias("iou"), containment("a", "b").alias("containment"))


class Groups:
    """The groups of one scan while its candidates come in order: each is kept by its first member, in all cells of a grid that this reaches into."""

    def __init__(self, cells: int = 16):
        self.cells, self.firsts, self.sizes, self.at = cells, [], [], {}

    def reach(self, cx: float, cy: float, w: float, h: float) -> tuple[int, ...]:
        """The cells x0 to x1, y0 to y1 that a box reaches into."""
        return tuple(int(min(max(e * self.cells // 1, 0), self.cells - 1)) for e in (cx - w / 2, cx + w / 2, cy - h / 2, cy + h / 2))

    def place(self, cx: float, cy: float, w: float, h: float, joins: Callable[[float, float], bool]) -> tuple[int, int]:
        """(group, rank in it). Only first members in the same cells are looked at: others share nothing with the candidate."""
        x0, x1, y0, y1 = self.reach(cx, cy, w, h) if len(self.firsts) > FEW else (0, 0, 0, 0)
        # A few groups are looked at one by one: to note all cells of each takes longer.
        for g in range(len(self.firsts)) if len(self.firsts) <= FEW else sorted({g for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) for g in self.at.get((x, y), ())}):
            if joins(*_shares(self.firsts[g], (cx, cy, w, h))):
                self.sizes[g] += 1
                return g, self.sizes[g]
        self.firsts.append((cx, cy, w, h))
        self.sizes.append(0)
        if len(self.firsts) > FEW:
            for g in range(len(self.firsts)) if len(self.firsts) == FEW + 1 else (len(self.firsts) - 1,):
                x0, x1, y0, y1 = self.reach(*self.firsts[g])
                for c in ((x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)):
                    self.at.setdefault(c, []).append(g)
        return len(self.firsts) - 1, 0


def _shares(p: tuple, i: tuple) -> tuple[float, float]:
    """(overlap over union, overlap over the smaller) of two upright boxes cx, cy, w, h."""
    side = lambda c, s: max(0.0, min(p[c] + p[s] / 2, i[c] + i[s] / 2) - max(p[c] - p[s] / 2, i[c] - i[s] / 2))
    inter, pa, ia = side(0, 2) * side(1, 3), p[2] * p[3], i[2] * i[3]
    union, smaller = pa + ia - inter, min(pa, ia)
    return inter / union if union > 0 else 0.0, inter / smaller if smaller > 0 else 0.0


def greedy_groups(candidates: DataFrame, order: list[Column], joins: Callable[[float, float], bool], keep: tuple[str, ...] = ()) -> DataFrame:
    """(scan_id, cand_id, group_no, rank, keep): in the given order, a candidate joins the first group that joins(overlap over union, overlap over the smaller) with its
    first member, else it opens one. Ties end with cand_id. Boxes without overlap must not join; null boxes aren't allowed.

    Scans are brought together and sorted; a task passes over the rows and holds one scan's groups at a time, so time is linear in candidates that lie apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, groups = object(), Groups()
        for b in batches:
            out = []
            for s, *box in zip(*(b.column(c).to_pylist() for c in ("scan_id", "cx", "cy", "w", "h")), strict=True):
                if s != scan:
                    scan, groups = s, Groups()
                out.append(groups.place(*box, joins))
            made = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([b.column("scan_id"), b.column("cand_id"), *(pa.array(c, pa.int32()) for c in made), *(b.column(f"k{k}") for k in range(len(keep)))], ["scan_id", "cand_id", "group_no", "rank", *keep])

    by = [o.alias(f"o{k}") for k, o in enumerate(order)]
    rows = candidates.select(F.col("scan_id").cast("long").alias("scan_id"), F.col("cand_id").cast("long").alias("cand_id"), *(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "w", "h")), *by, *(F.col(c).alias(f"k{k}") for k, c in enumerate(keep)))
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    ordered = rows.repartition("scan_id").sortWithinPartitions("scan_id", *(f"o{k}" for k in range(len(by))), "cand_id", "cx", "cy", "w", "h")
    return ordered.mapInArrow(run, "scan_id long, cand_id long, group_no int, rank int" + "".join(f", {k} {kinds[k]}" for k in keep))


def group_candidates(candidates: DataFrame, iou_over: float = IOU, contained_over: float = CONTAINED) -> DataFrame:
    """Groups by descending score, then area: overlap or containment with a group's first member joins it."""

    return greedy_groups(candidates, [-F.col("score"), -(F.col("w") * F.col("h"))], lambda shared, inside: shared > iou_over or inside > contained_over)


def vote_groups(candidates: DataFrame) -> DataFrame:
    """One row per scan: the winner of the largest group (then the larger first member) of proposals that agree, by rectangularity, then score, then the first."""
    groups = greedy_groups(candidates, [], lambda shared, _: shared >= SEED_IOU, ("w", "h", "score", "rectangularity"))
    sized = groups.groupBy("scan_id", "group_no").agg(F.count("*").alias("members"), F.max_by(F.col("w") * F.col("h"), -F.col("rank")).alias("seed_area"), F.max_by("cand_id", F.struct("rectangularity", "score", -F.col("cand_id"))).alias("winner"))
    return sized.groupBy("scan_id").agg(F.max_by(F.struct("winner", "members"), F.struct("members", "seed_area", -F.col("group_no"))).alias("b")).select("scan_id", "b.winner", "b.members")


def alternatives(groups: DataFrame, most: int | None = 3) -> DataFrame:
    """(scan_id, group_no, primary_id, choices): a group's first and the ids of the next ones, most at most (null: all)."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "cand_id"))), lambda x: x["cand_id"])
    g = groups.groupBy("scan_id", "group_no").agg(ids.alias("ids"))
    rest = F.slice("ids", F.lit(2), F.lit(most) if most else F.size("ids"))
    return g.select("scan_id", "group_no", F.element_at("ids", 1).alias("primary_id"), rest.alias("choices"))


def choose_alternative(groups: DataFrame, choice: Column) -> DataFrame:
    """Swaps the chosen alternative (1 and up; null or out of range: none) with the primary; other places stay."""
    k = F.when((choice >= 1) & (choice <= F.size("choices")), choice.cast("int"))
    g = settled(groups, k=k)
    g = settled(g, chosen=F.coalesce(F.get("choices", F.col("k") - 1), F.col("primary_id")))
    swapped = F.transform("choices", lambda x: F.when(x == F.col("chosen"), F.col("primary_id")).otherwise(x))
    return g.withColumn("choices", swapped).select("scan_id", "group_no", "chosen", "choices").withColumnRenamed("chosen", "primary_id")


def cycle_alternatives(groups: DataFrame) -> DataFrame:
    """The first alternative becomes the primary, which goes last."""
    some = F.size("choices") > 0
    return groups.select("scan_id", "group_no", F.when(some, F.get("choices", F.lit(0))).otherwise(F.col("primary_id")).alias("primary_id"), F.when(some, F.concat(F.slice("choices", F.lit(2), F.size("choices")), F.array("primary_id"))).otherwise(F.col("choices")).alias("choices"))


def engine_fallback(model: DataFrame, classic: DataFrame) -> DataFrame:
    """The model's rows of each scan, or the classic ones where it has none, with the engine's name."""
    rest = classic.join(model.select("scan_id").distinct(), "scan_id", "left_anti")
    return model.withColumn("engine", F.lit("model")).unionByName(rest.withColumn("engine", F.lit("classic")))


def hit_test(points: DataFrame, candidates: DataFrame, slack: float = 1.05) -> DataFrame:
    """(point_id, cand_id): for each point of a scan the first candidate whose box, a little enlarged, holds it; null if none."""
    inside = (F.abs(F.col("px") - F.col("cx")) <= F.col("w") / 2 * slack) & (F.abs(F.col("py") - F.col("cy")) <= F.col("h") / 2 * slack)
    hits = points.join(candidates, "scan_id").where(inside).groupBy("point_id").agg(F.min("cand_id").alias("cand_id"))
    return points.select("point_id").join(hits, "point_id", "left")


def best_of_prompt(masks: DataFrame) -> DataFrame:
    return masks.groupBy("scan_id").agg(F.max_by("mask_id", F.struct("score", -F.col("prompt_id"))).alias("mask_id"), F.max("score").alias("score"))


def merge_bounds(merges: DataFrame) -> DataFrame:
    """(merge_id, cx, cy, w, h, score, parts): upright box of unturned rectangles merged, with the lowest score and the parts; a merge of one part is none."""
    edge = lambda c, s, sign: F.col(c) + sign * F.col(s) / 2
    g = merges.groupBy("merge_id").agg(F.count("*").alias("n"), F.min(edge("cx", "w", -1)).alias("x0"), F.max(edge("cx", "w", 1)).alias("x1"), F.min(edge("cy", "h", -1)).alias("y0"), F.max(edge("cy", "h", 1)).alias("y1"), F.min("score").alias("score"), F.sort_array(F.collect_list("cand_id")).alias("parts"))
    return g.where("n >= 2").select("merge_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "score", "parts")


def undo_merge(merged: DataFrame) -> DataFrame:
    """The parts back in order at the merged one's place."""
    return merged.select("merge_id", F.posexplode("parts").alias("position", "cand_id"))


def tight_shot(winners: DataFrame) -> DataFrame:
    """Takes the frame's answer when it has four sides and the vote's winner is under 6 percent of the page."""
    return winners.withColumn("method", F.when(F.col("four_sided") & (F.col("winner_area") < 0.06), "frame").otherwise("vote"))


def nearest_size(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(scan_id, item, cand_id, off): for each expected size the found one of its scan nearest in L1, whichever way up; the first of equals."""
    long_, short = F.abs(F.greatest("ew", "eh") - F.greatest("w", "h")), F.abs(F.least("ew", "eh") - F.least("w", "h"))
    j = expected.join(found, "scan_id").withColumn("off", long_ + short)
    return j.groupBy("scan_id", "item").agg(F.min_by(F.struct("cand_id", "off"), F.struct("off", "cand_id")).alias("b")).select("scan_id", "item", "b.*")


def size_class(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, n): how many sizes fall in each class's ranges of millimetres."""
    inside = F.col("long_mm").between(F.col("long_low"), F.col("long_high")) & F.col("short_mm").between(F.col("short_low"), F.col("short_high"))
    return sizes.join(F.broadcast(classes), inside).groupBy("class").agg(F.count("*").alias("n"))


def clean_rectangle(shapes: DataFrame) -> DataFrame:
    """(scan_id, mask_id): of scans whose best-scored mask is not like a document, the largest that could be a whole one, the first of equals."""
    best = shapes.groupBy("scan_id").agg(F.max_by("document_like", F.struct("score", -F.col("mask_id"))).alias("like"), F.max_by("mask_id", F.when(F.col("whole_like"), F.struct("area", -F.col("mask_id")))).alias("mask_id"))
    return best.where(~F.col("like") & F.col("mask_id").isNotNull()).select("scan_id", "mask_id")


def prefer_whole(winners: DataFrame, candidates: DataFrame, slack: float = 0.01, larger: float = 1.15) -> DataFrame:
    """(scan_id, cand_id, method): the largest candidate that holds a scan's winner, is clearly larger and doesn't go on beyond its box; else the whole page if print goes on beyond the winner; else the winner.

    Both have the box x0, y0, x1, y1, its area and beyond.
    """
    w, c = winners.alias("w"), candidates.alias("c")
    holds = (F.col("c.scan_id") == F.col("w.scan_id")) & (F.col("c.area") > larger * F.col("w.area")) & (F.col("c.x0") <= F.col("w.x0") + slack) & (F.col("c.y0") <= F.col("w.y0") + slack) & (F.col("c.x1") >= F.col("w.x1") - slack) & (F.col("c.y1") >= F.col("w.y1") - slack) & ~F.col("c.beyond")
    wholes = w.join(c, holds).groupBy("w.scan_id").agg(F.max_by("c.cand_id", F.struct("c.area", -F.col("c.cand_id"))).alias("whole_id"))
    j = winners.join(wholes, "scan_id", "left")
    page = F.col("whole_id").isNull() & F.col("beyond")
    return j.select("scan_id", F.when(~page, F.coalesce("whole_id", "cand_id")).alias("cand_id"), F.when(page, "page").otherwise("vote").alias("method"))


def detection_result(scans: DataFrame, ring: DataFrame, clean: DataFrame, vote: DataFrame) -> DataFrame:
    """(scan_id, mask_id, method) by the first that applies: a document-like best mask, grown if a larger one adds printed ring; a clean rectangle; the vote; the best mask; the whole page.

    scans: scan_id, best_id, best_like (both null: the frame gave no shape). ring, clean, vote: scan_id and mask_id (null in vote: the page).
    """
    r, c = ring.select("scan_id", F.col("mask_id").alias("ring_id")), clean.select("scan_id", F.col("mask_id").alias("clean_id"))
    v = vote.select("scan_id", F.col("mask_id").alias("vote_id"), F.lit(True).alias("voted"))
    j = scans.join(r, "scan_id", "left").join(c, "scan_id", "left").join(v, "scan_id", "left")
    like = F.coalesce("best_like", F.lit(False))
    mask = F.when(like, F.coalesce("ring_id", "best_id")).when(F.col("clean_id").isNotNull(), F.col("clean_id")).when(F.col("voted"), F.col("vote_id")).otherwise(F.col("best_id"))
    method = F.when(like | F.col("clean_id").isNotNull(), "frame").when(F.col("voted"), F.when(F.col("vote_id").isNull(), "page").otherwise("vote")).when(F.col("best_id").isNull(), "page").otherwise("frame")
    return j.select("scan_id", mask.alias("mask_id"), method.alias("method"))
