"""Faces, embeddings and identities: association, gallery match, clustering, enrolment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as P
from ..functions.vectors import block_bounds, cosine_blocks, mean_vector, metric_blocks, score_blocks, score_cells
from ..session import cut_lineage
from .kernels import bounded_lag, exact_quantiles, gap_islands, ordered_index, stream_fold, top_k

THRESHOLD, MARGIN, SAME_PERSON = 0.35, 0.12, 0.5
PAIR = {"p05": 0.05, "median": 0.5, "p95": 0.95}


def associate_faces(persons: DataFrame, faces: DataFrame, keys: Sequence[str] = ("dataset", "frame_no"), cell: int = 64) -> DataFrame:
    """First quality face per person by centre-inside; a face two boxes claim is dropped.

    persons: keys, person_id, px0..py1.  faces: keys, face_id, fx0..fy1, eye_px, det_score.
    A box is listed in the grid cells it covers, a face centre lives in exactly one.
    """
    def span(a, b):
        return F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    p = persons.withColumn("_gx", F.explode(span("px0", "px1"))).withColumn("_gy", F.explode(span("py0", "py1")))
    f = faces.withColumn("_cx", (F.col("fx0") + F.col("fx1")) / 2.0).withColumn("_cy", (F.col("fy0") + F.col("fy1")) / 2.0)
    f = f.withColumn("_gx", F.floor(F.col("_cx") / cell)).withColumn("_gy", F.floor(F.col("_cy") / cell))
    inside = f.join(p, [*keys, "_gx", "_gy"]).filter(
        (F.col("px0") <= F.col("_cx")) & (F.col("_cx") <= F.col("px1")) & (F.col("py0") <= F.col("_cy")) & (F.col("_cy") <= F.col("py1")))
    once = inside.groupBy(*keys, "face_id").agg(F.count(F.lit(1)).alias("claims"), F.first("person_id").alias("person_id"),
                                                F.first("eye_px").alias("eye_px"), F.first("det_score").alias("det_score"))
    good = once.filter((F.col("claims") == 1) & P.face_quality(F.col("eye_px"), F.col("det_score")))
    return good.groupBy(*keys, "person_id").agg(F.min("face_id").alias("face_id"), F.count(F.lit(1)).alias("usable"))


BEST = "vec_id long, player long, sim double, l_block long"


def gallery_pairs(left: DataFrame, right: DataFrame, two_best) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs scored first, other pairs to score, best players of the first).

    The gallery block of the highest bound, and the highest with another player if that one holds a single
    player, give every probe a runner-up.  A block pair is left out when its bound is below the smallest
    runner-up of its probes: nothing in it can be best or runner-up.
    """
    held = right.select("r_block", F.array_min("r_player").alias("lo"), F.array_max("r_player").alias("hi"))
    w = W.partitionBy("l_block")
    # blocks of broken vectors have no bound; they are scored, but not first
    order = w.orderBy((F.col("bound") == float("inf")), F.desc("bound"), "r_block")
    ranked = block_bounds(left, right).join(held, "r_block").withColumn("place", F.row_number().over(order)).withColumn("_p", F.first("lo").over(order))
    other = F.when((F.col("lo") != F.col("_p")) | (F.col("hi") != F.col("_p")), F.col("place"))
    ranked = cut_lineage(ranked.withColumn("_o", F.min(other).over(w)).select(
        "l_block", "r_block", "bound", ((F.col("place") == 1) | (F.col("place") == F.coalesce("_o", F.lit(1)))).alias("seed")))
    seeds = ranked.filter("seed")
    seen = cut_lineage(score_blocks(left, right, seeds, ["vec_id"], ["vec_id", "player"], two_best, BEST))
    per = seen.groupBy("l_block", "vec_id", "player").agg(F.max("sim").alias("sim"))
    # with one player only a probe has no runner-up yet, so everything is still to score
    second = per.groupBy("l_block", "vec_id").agg(F.get(F.reverse(F.array_sort(F.collect_list("sim"))), F.lit(1)).alias("second"))
    floors = second.groupBy("l_block").agg(F.min(F.coalesce("second", F.lit(float("-inf")))).alias("floor"))
    rest = ranked.filter("not seed").join(floors, "l_block").filter(F.col("bound") >= F.col("floor"))
    return seeds, rest, seen


def match_gallery(probes: DataFrame, gallery: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN,
                  bind_bar: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Best and runner-up player per probe by the largest cosine, with both accept rules.

    Exact: each block pair reports its two best players, and the overall runner-up is
    always among the two best of its own block.  Block pairs whose bound lies below every
    runner-up found so far are not scored.  A NaN similarity never matches.
    """
    bar = round(threshold + margin, 4) if bind_bar is None else bind_bar

    def two_best(sims, left, right):
        players, pos = np.unique(right["player"], return_inverse=True)
        per = np.full((sims.shape[0], len(players)), -np.inf)
        np.maximum.at(per.T, pos, np.where(np.isnan(sims), -np.inf, sims).T)
        order = np.argsort(-per, axis=1, kind="stable")[:, :2]
        rows = np.repeat(np.arange(len(per)), order.shape[1])
        cols = order.ravel()
        return {"vec_id": left["vec_id"][rows], "player": players[cols], "sim": per[rows, cols]}
    left, right = metric_blocks(probes.select("vec_id", "vec"), ["vec_id"], "l_"), metric_blocks(gallery.select("vec_id", "player", "vec"), ["vec_id", "player"], "r_")
    seeds, rest, seen = gallery_pairs(left, right, two_best)
    best = seen.unionByName(score_blocks(left, right, rest, ["vec_id"], ["vec_id", "player"], two_best, BEST)).select("vec_id", "player", "sim")
    per = best.groupBy("vec_id", "player").agg(F.max("sim").alias("sim"))
    ranked = per.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("k"), "player", "sim"))).alias("_r"))
    out = ranked.select("vec_id", F.col("_r")[0]["player"].alias("player"), F.col("_r")[0]["sim"].alias("similarity"),
                        F.get(F.col("_r"), F.lit(1))["sim"].alias("runner_up"))
    clear = F.col("runner_up").isNull() | (F.col("similarity") - F.col("runner_up") >= margin)
    out = out.withColumn("accepted", (F.col("similarity") >= threshold) & clear).withColumn("bound", (F.col("similarity") >= bar) & clear)
    return probes.select("vec_id", *keep).join(out, "vec_id", "left")


def evaluate_binding(matched: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, bar: float = 0.47) -> DataFrame:
    """Correct / wrong / unmatched by role with totals, and why the rest was rejected."""
    hit = F.col("accepted") & (F.col("player") == F.col("expected"))
    wrong = F.col("accepted") & (F.col("player") != F.col("expected"))
    out = matched.rollup("role").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct"), F.count_if(wrong).alias("wrong"), F.count_if("bound").alias("bound"),
        F.count_if(F.col("similarity") < threshold).alias("below_threshold"), F.count_if(F.col("similarity") < bar).alias("below_bind_bar"),
        F.count_if((F.col("similarity") >= threshold) & (F.col("similarity") - F.col("runner_up") < margin)).alias("ambiguous"),
        F.grouping("role").cast("long").alias("level"))
    return out.withColumn("unmatched", F.col("n") - F.col("correct") - F.col("wrong")).withColumn("accuracy", F.col("correct") / F.col("n"))


def bind_counts(probes: DataFrame, gallery: DataFrame, bar: float) -> DataFrame:
    """Per enrolled player: own and foreign probes, and how many of each clear the bar.

    Only block pairs whose bound reaches the bar are scored, and of a block only (probe, player) pairs that clear the bar leave the task.
    """
    def clearing(sims, left, right):
        players, pos = np.unique(right["player"], return_inverse=True)
        hit = np.zeros((len(sims), len(players)), dtype=bool)
        i, j = np.nonzero(sims >= bar)
        hit[i, pos[j]] = True
        i, j = np.nonzero(hit)
        return {"vec_id": left["vec_id"][i], "expected": left["expected"][i], "player": players[j]}
    left = metric_blocks(probes.select("vec_id", "expected", "vec"), ["vec_id", "expected"], "l_")
    # a face of nobody counts for no player
    right = metric_blocks(gallery.filter(F.col("player").isNotNull()).select("vec_id", "player", "vec"), ["vec_id", "player"], "r_")
    hits = score_cells(left, right, bar, ["vec_id", "expected"], ["vec_id", "player"], clearing, "vec_id long, expected long, player long")
    own = F.col("expected") == F.col("player")
    got = hits.groupBy("player").agg(F.count_if(own).alias("own_bound"), F.count_if(~own).alias("other_clearing"))
    total = probes.groupBy(F.col("expected").alias("player")).agg(F.count(F.lit(1)).alias("own_n"))
    everyone = probes.agg(F.count(F.lit(1)).alias("all_n"))
    base = gallery.select("player").distinct().join(total, "player", "left").crossJoin(everyone).withColumn("own_n", F.coalesce("own_n", F.lit(0)))
    return base.join(got, "player", "left").select("player", "own_n", F.coalesce("own_bound", F.lit(0)).alias("own_bound"),
                                                   (F.col("all_n") - F.col("own_n")).alias("other_n"), F.coalesce("other_clearing", F.lit(0)).alias("other_clearing"))


def detectability(instances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gate yields per person instance over single-column grouping sets and the total."""
    quality = P.face_quality(F.col("eye_px"), F.col("det_score"))
    i = instances.withColumn("_q", quality)
    parts = None
    for k in [None, *keys]:
        g = i.groupBy(*([k] if k else [])).agg(
            F.count(F.lit(1)).alias("instances"), F.count_if("inside").alias("inside_box"), F.count_if(F.col("eye_px") >= 8).alias("eye_pass"),
            F.count_if(F.col("det_score") >= 0.4).alias("det_pass"), F.count_if("_q").alias("quality_pass"), F.count_if(F.col("_q") & F.col("inside")).alias("selected"))
        g = g.select(F.lit(k or "all").alias("grouping"), (F.col(k).cast("string") if k else F.lit("all")).alias("value"), *g.columns[1 if k else 0:])
        parts = g if parts is None else parts.unionByName(g)
    return parts.withColumn("yield_rate", F.col("selected") / F.col("instances"))


def pair_cosines(faces: DataFrame, key: str, differ: str) -> DataFrame:
    """Cosines of the unordered pairs of a key whose ``differ`` column differs."""
    def emit(sims, left, right):
        keep = (left["vec_id"][:, None] < right["vec_id"][None, :]) & (left[differ][:, None] != right[differ][None, :])
        i, j = np.nonzero(keep)
        return {"a": left["vec_id"][i], "b": right["vec_id"][j], "cos": sims[i, j]}
    f = faces.select(key, "vec_id", differ, "vec")
    return cosine_blocks(f, f, [key], ["vec_id", differ], ["vec_id", differ], emit, f"a long, b long, cos double, {key} long")


def separation(faces: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """Within-tracklet pairs of different frames against same-frame pairs of different tracklets."""
    w = pair_cosines(faces, "tracklet", "frame").select(F.lit("within").alias("kind"), "cos")
    c = pair_cosines(faces, "frame", "tracklet").select(F.lit("cross").alias("kind"), "cos")
    both = w.unionByName(c)
    rates = both.groupBy("kind").agg(F.avg(P.at_least(F.col("cos"), threshold).cast("double")).alias("ge_threshold"),
                                     F.avg(P.at_least(F.col("cos"), threshold + margin).cast("double")).alias("ge_bind_bar"))
    return exact_quantiles(both, ["kind"], "cos", PAIR).join(rates, "kind")


def medoids(faces: DataFrame, keys: Sequence[str] = ("burst", "role")) -> DataFrame:
    """The face most similar to the others of its group (block-wise row sums, first id on a tie)."""
    def sums(sims, left, right):
        same = left["vec_id"][:, None] == right["vec_id"][None, :]
        return {"vec_id": left["vec_id"], "part": np.where(same, 0.0, sims).sum(axis=1)}
    f = faces.select(*keys, "vec_id", "vec")
    part = cosine_blocks(f, f, list(keys), ["vec_id"], ["vec_id"], sums, "vec_id long, part double, " + ", ".join(f"{k} long" for k in keys))
    total = part.groupBy(*keys, "vec_id").agg(F.sum("part").alias("score"))
    best = total.groupBy(*keys).agg(F.min(F.struct((-F.round("score", 9)).alias("k"), "vec_id")).alias("b"), F.count(F.lit(1)).alias("faces"))
    return best.select(*keys, "faces", F.col("b.vec_id").alias("vec_id")).join(faces.select("vec_id", "vec"), "vec_id")


def continuity(med: DataFrame, bar: float = SAME_PERSON) -> DataFrame:
    """Cosine of each medoid with the one of the next burst of the same role."""
    nxt = med.select("role", (F.col("burst") - 1).alias("burst"), F.col("vec_id").alias("next_id"), F.col("vec").alias("_v"))
    out = med.join(nxt, ["role", "burst"]).withColumn("cosine", P.cosine(F.col("vec"), F.col("_v")))
    return out.select("role", "burst", "vec_id", "next_id", "cosine", P.at_least(F.col("cosine"), bar).alias("same_person"))


def longest_run(cont: DataFrame) -> DataFrame:
    """Longest chain of consecutive bursts where one role keeps its person (earliest on a tie)."""
    runs = gap_islands(cont.filter("same_person"), ["role"], "burst", 1, 4096, name="start").groupBy("role", "start").agg(F.count(F.lit(1)).alias("links"))
    return runs.groupBy().agg(F.min(F.struct((-F.col("links")).alias("k"), "role", "start", "links")).alias("b")).filter("b is not null").select(
        "b.role", F.col("b.start").alias("enroll_burst"), (F.col("b.links") + 1).alias("bursts"))


def label_probes(faces: DataFrame, med: DataFrame, bar: float = 0.6) -> DataFrame:
    """Each face against the medoid of its own burst and role."""
    m = med.select("burst", "role", F.col("vec").alias("_m"))
    out = faces.join(m, ["burst", "role"]).withColumn("medoid_cosine", P.cosine(F.col("vec"), F.col("_m")))
    return out.withColumn("grp", F.when(P.at_least(F.col("medoid_cosine"), bar), "same").otherwise("impostor_same_end")).drop("_m", "vec")


def leader_cluster(faces: DataFrame, keys: Sequence[str], order: Sequence, bar: float = SAME_PERSON) -> DataFrame:
    """First leader within the bar in leader order, else the face leads a new group.

    Sequential by definition; only the leaders are held, faces stream past them.
    """
    import pandas as pd

    def make():
        return {"lead": None, "n": 0}

    def step(state, pdf):
        out = []
        for vec in pdf["vec"]:
            v = np.asarray(vec, dtype=np.float64)
            n = np.sqrt(v @ v)
            u = v / n if n > 0 else np.zeros_like(v)
            hit = np.flatnonzero(state["lead"][: state["n"]] @ u >= bar) if state["n"] else ()
            if len(hit):
                out.append(int(hit[0]))
                continue
            if state["lead"] is None:
                state["lead"] = np.zeros((16, len(u)))
            elif state["n"] == len(state["lead"]):
                state["lead"] = np.vstack([state["lead"], np.zeros_like(state["lead"])])
            state["lead"][state["n"]] = u
            out.append(state["n"])
            state["n"] += 1
        got = {k: pdf[k].to_numpy() for k in keys}
        return pd.DataFrame({**got, "vec_id": pdf["vec_id"].to_numpy(), "tracklet": pdf["tracklet"].to_numpy(), "grp": out})
    cols = list(dict.fromkeys([*keys, "vec_id", "tracklet", "vec", *[o for o in order if isinstance(o, str)], "rank"]))
    schema = ", ".join(f"{k} long" for k in keys) + ", vec_id long, tracklet long, grp long"
    return stream_fold(faces.select(*cols), keys, order, make, step, schema)


def track_groups(clustered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Track -> group by vote; the lower group on a tie."""
    votes = clustered.groupBy(*keys, "tracklet", "grp").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(*keys, "tracklet").agg(F.max(F.struct("votes", (-F.col("grp")).alias("g"))).alias("b"), F.sum("votes").alias("faces")).select(
        *keys, "tracklet", "faces", (-F.col("b.g")).alias("grp"), F.col("b.votes").alias("votes"))


def plan_enrollment(faces: DataFrame, k: int = 5, bar: float = SAME_PERSON, min_kept: int = 2, min_purity: float = 0.5, min_probes: int = 2) -> DataFrame:
    """Up to k mutually consistent faces per track, then purity of the rest, typed refusals.

    Pass 1 streams the ranked faces with at most k kept vectors in state; pass 2 joins
    those few vectors back to score the rest.
    """
    import pandas as pd

    def make():
        return {"kept": [], "seen": 0}

    def step(state, pdf):
        flags = []
        for vec in pdf["vec"]:
            v = np.asarray(vec, dtype=np.float64)
            n = np.sqrt(v @ v)
            u = v / n if n > 0 else np.zeros_like(v)
            if state["seen"] == 0 or (len(state["kept"]) < k and min(float(x @ u) for x in state["kept"]) >= bar):
                state["kept"].append(u)
                flags.append(True)
            else:
                flags.append(False)
            state["seen"] += 1
        return pd.DataFrame({"tracklet": pdf["tracklet"].to_numpy(), "vec_id": pdf["vec_id"].to_numpy(), "kept": flags})
    ranked = faces.filter(P.face_quality(F.col("eye_px"), F.col("det_score"))).withColumn("rank", -P.rank_score(F.col("det_score"), F.col("eye_px")))
    flags = stream_fold(ranked.select("tracklet", "rank", "vec_id", "vec"), ["tracklet"], ["rank", "vec_id"], make, step, "tracklet long, vec_id long, kept boolean")
    flags = cut_lineage(flags)  # read by the bank, the rest and the totals
    marked = ranked.select("tracklet", "vec_id", "vec").join(flags, ["tracklet", "vec_id"])
    bank = marked.filter("kept").groupBy("tracklet").agg(F.collect_list("vec").alias("_bank"))
    agrees = F.exists("_bank", lambda b: P.at_least(P.cosine(F.col("vec"), b), bar))
    rest = marked.filter("not kept").join(bank, "tracklet").withColumn("_a", agrees)
    purity = rest.groupBy("tracklet").agg(F.count(F.lit(1)).alias("probes"), F.count_if("_a").alias("agreeing"))
    out = marked.groupBy("tracklet").agg(F.count(F.lit(1)).alias("usable"), F.count_if("kept").alias("kept")).join(purity, "tracklet", "left").fillna(0, ["probes", "agreeing"])
    share = F.when(F.col("probes") > 0, F.col("agreeing") / F.nullif(F.col("probes"), F.lit(0)))
    out = out.withColumn("purity", share)
    outcome = (F.when(F.col("usable") < min_kept, "single_face_only").when(F.col("kept") < min_kept, "inconsistent_faces")
               .when((F.col("probes") >= min_probes) & (F.col("purity") < min_purity), "mixed_track").otherwise("enrolled"))
    return out.withColumn("outcome", outcome)


def cluster_banks(obs: DataFrame, key: str = "tracklet", faces: int = 3, bank: int = 32) -> tuple[DataFrame, DataFrame]:
    """(best face samples by det*eye, mean of the last ``bank`` vectors) per cluster."""
    r = obs.withColumn("rank_value", P.rank_score(F.col("det_score"), F.col("eye_px")))
    best = top_k(r, [key], [F.desc("rank_value"), "vec_id"], faces, F.col("vec_id"))
    last = top_k(obs, [key], [F.desc("frame"), F.desc("vec_id")], bank, F.col("vec_id"))
    return best.select(key, "rank", "vec_id", "rank_value"), mean_vector(last, [key])


def prototypes(tracks: DataFrame, seeds: DataFrame, labels: Sequence[str] = ("A", "B")) -> DataFrame:
    """Mean unit vector per explicit label; rows without an explicit label are ignored."""
    s = seeds.filter(F.col("seed").isin(*labels)).select("tracklet", "seed")
    return mean_vector(tracks.join(s, "tracklet").select("seed", "vec"), ["seed"], unit=True)


def label_tracks(tracks: DataFrame, protos: DataFrame, margin: float = 0.05, labels: Sequence[str] = ("A", "B")) -> DataFrame:
    """Nearest prototype per row and its lead over the next one; ``labels`` bounds the prototypes to one row each."""
    named = protos.filter(F.col("seed").isin(*labels)).groupBy("seed").agg(F.first("vec").alias("_p"))
    sims = tracks.crossJoin(F.broadcast(named)).withColumn("_c", P.cosine(F.col("vec"), F.col("_p")))
    best = sims.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_c")).alias("k"), "seed"))).alias("_r"))
    gap = F.get(F.col("_r"), F.lit(1))["k"] - F.col("_r")[0]["k"]
    return best.select("vec_id", F.col("_r")[0]["seed"].alias("label"), (-F.col("_r")[0]["k"]).alias("similarity"), gap.alias("gap"),
                       F.when(gap.isNull() | (gap >= margin), "embedding").otherwise("ambiguous").alias("method"))


def attribute_actor(shots: DataFrame, persons: DataFrame, keys: Sequence[str] = ("dataset", "frame_no")) -> DataFrame:
    """Person whose foot is nearest to the cue ball in the frame of the shot."""
    j = shots.join(persons, list(keys)).withColumn("d2", (F.col("cx") - F.col("fx")) * (F.col("cx") - F.col("fx")) + (F.col("cy") - F.col("fy")) * (F.col("cy") - F.col("fy")))
    return j.groupBy(*keys, "shot_id").agg(F.min(F.struct("d2", "person_id")).alias("b")).select(*keys, "shot_id", F.col("b.person_id").alias("person_id"), F.col("b.d2").alias("d2"))


def actor_stats(shots: DataFrame, key: str = "dataset") -> DataFrame:
    """Assignments, switches between adjacent shots and close calls per recording."""
    i = bounded_lag(ordered_index(shots, [key], ["shot_id"], "us", 86_400_000_000), [key], "idx", ["actor"])
    return i.groupBy(key).agg(F.count_if(F.col("actor") == "A").alias("a"), F.count_if(F.col("actor") == "B").alias("b"),
                              F.count_if(F.col("prev_actor") != F.col("actor")).alias("switches"), F.count_if(F.col("gap") < 0.05).alias("close_calls"))


def forget(gallery: DataFrame, clusters: DataFrame, forgotten: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gallery without the players, clusters with their binding removed, counts per player)."""
    kept = gallery.join(forgotten.select("player"), "player", "left_anti")
    mark = forgotten.select("player", F.lit(True).alias("_gone"))
    free = clusters.join(mark, "player", "left").withColumn("player", F.when(F.col("_gone").isNull(), F.col("player"))).drop("_gone")
    faces = gallery.join(forgotten.select("player"), "player", "left_semi").groupBy("player").agg(F.count(F.lit(1)).alias("faces"))
    bound = clusters.join(forgotten.select("player"), "player", "left_semi").groupBy("player").agg(F.count(F.lit(1)).alias("clusters"))
    return kept, free, forgotten.select("player").join(faces, "player", "left").join(bound, "player", "left").fillna(0)


def add_faces(gallery: DataFrame, additions: DataFrame) -> DataFrame:
    """Append with positions that continue after each player's last stored one."""
    last = gallery.groupBy("player").agg((F.max("position") + 1).alias("_next"))
    new = ordered_index(additions, ["player"], [], "vec_id", 4096, "_i").join(last, "player", "left")
    new = new.withColumn("position", F.col("_i") + F.coalesce("_next", F.lit(0))).drop("_i", "_next")
    return gallery.unionByName(new)
