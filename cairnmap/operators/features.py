"""Registration by features: cells around key points, matches between frames, poses from matched cells, rotations from dominant directions."""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cells import COV, MEAN, with_eigenvalues
from .registration import _pair_terms, _solve, directions, twist


def feature_cells(points: DataFrame, by: tuple[str, ...], spread: float, least: int = 6) -> DataFrame:
    """by, n, mean, covariance of the points around each key point; cells whose largest standard deviation reaches ``spread`` are left out."""
    pairs = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
    own = [F.count("*").alias("n"), *(F.avg(a).alias("m" + a) for a in G.AXES), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs)]
    made = with_eigenvalues(points.groupBy(*by).agg(*own).filter(F.col("n") >= least))
    return made.filter(F.sqrt("l2") < spread).drop("l0", "l1", "l2")


def frame_matches(features: DataFrame, frame: str, feature: str, vector: str) -> DataFrame:
    """pair, l_id, r_id, dist: mutual nearest descriptors of every frame (pair) and the one before it. Frames are numbered without gaps.

    Candidates are a frame's features times those of one other frame, by equality on the frame.
    """
    l = features.select(F.col(frame).cast("long").alias("pair"), F.col(feature).alias("l_id"), F.col(vector).alias("l_v"))
    r = features.select((F.col(frame).cast("long") + 1).alias("pair"), F.col(feature).alias("r_id"), F.col(vector).alias("r_v"))
    d = F.aggregate(F.zip_with("l_v", "r_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = l.join(r, "pair").select("pair", "l_id", "r_id", F.sqrt(d.cast("double")).alias("dist"))
    forward = pairs.groupBy("pair", "l_id").agg(F.min(F.struct("dist", "r_id")).alias("b")).select("pair", "l_id", "b.r_id", "b.dist")
    back = pairs.groupBy("pair", "r_id").agg(F.min(F.struct("dist", "l_id")).alias("b")).select("pair", "b.l_id", "r_id")
    return forward.join(back, ["pair", "l_id", "r_id"])


def _rigid(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd((t - t.mean(0)).T @ (s - s.mean(0)))
    out = np.eye(4)
    out[:3, :3] = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    out[:3, 3] = t.mean(0) - out[:3, :3] @ s.mean(0)
    return out


def _newton(ms, cs, mt, ct, pose: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    def evaluated(t):
        return _pair_terms(ms @ t[:3, :3].T + t[:3, 3], t[:3, :3] @ cs @ t[:3, :3].T, mt, ct)

    score, g, h = evaluated(pose)
    for _ in range(rounds):
        row = {f"g{i}": g[i] for i in range(6)} | {f"h{i}{j}": h[i, j] for i in range(6) for j in range(i, 6)}
        step = _solve(row, (0, 1, 2, 3, 4, 5))[2]
        for _ in range(6):
            new = evaluated(twist(step) @ pose)
            if new[0] < score - 1e-9:
                break
            step = step / 2
        else:
            break
        pose, (score, g, h) = twist(step) @ pose, new
        if np.linalg.norm(step) < tolerance:
            break
    return pose, score


def match_features(matches: DataFrame, by: str, hypotheses: int = 200, within: float = 0.1, rounds: int = 30, seed: int = 4) -> DataFrame:
    """by, inliers, score and the pose of every group of matched cells (means and covariances, those of the fixed side with the prefix t_).

    A group is the matches of one pair of frames and is worked on in one task: seeded triples give a pose and its inliers, whose
    cells' score is then minimised. Groups of fewer than three matches give no row; ties between hypotheses take the first.
    """
    names = [*MEAN, *COV]
    kind = dict(matches.dtypes)[by]
    schema = f"`{by}` {kind}, inliers long, score double, pose array<double>"

    def run(key, rows):
        rows = rows.sort_by([(n, "ascending") for n in (*MEAN, *("t_" + m for m in MEAN))])
        a, b = (np.column_stack([rows[p + c].to_numpy() for c in names]).astype(float).reshape(-1, 9) for p in ("", "t_"))
        s, t, draw, best = a[:, :3], b[:, :3], np.random.default_rng(seed), (0, np.zeros(len(a), bool))
        for _ in range(hypotheses if len(a) >= 3 else 0):
            own = draw.choice(len(a), 3, replace=False)
            pose = _rigid(s[own], t[own])
            good = np.linalg.norm(s @ pose[:3, :3].T + pose[:3, 3] - t, axis=1) < within
            best = max(best, (int(good.sum()), good), key=lambda x: x[0])
        out = ([], [], [], [])
        if best[0] >= 3:
            good = best[1]
            full = lambda c: c[:, 3:][:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            pose, score = _newton(s[good], full(a[good]), t[good], full(b[good]), _rigid(s[good], t[good]), rounds, 1e-6)
            out = ([key[0].as_py()], [best[0]], [score], [pose.reshape(-1).tolist()])
        return pa.table([pa.array(out[0], rows.schema.field(by).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.list_(pa.float64()))], names=[by, "inliers", "score", "pose"])

    return matches.select(by, *names, *("t_" + n for n in names)).groupBy(by).applyInArrow(run, schema)


def rotation_fits(histograms: DataFrame, pairs: DataFrame, by: str, n: int = 3, least: int = 3, bins: int = 40, top: int = 3) -> DataFrame:
    """a, b, rank, gap, pose-free rotation (nine numbers): the ``top`` rotations of map a's direction histogram onto map b's.

    histograms: by, bin, n; pairs: a, b. Two dominant directions of a go onto two of b, in every way (18 at most), by the closed form; gap is the
    L2 of the shares of a's bins and of the bins of b that they fall on. One pair's bins (80 at most) are one row.
    """
    held = histograms.groupBy(by).agg(F.collect_list(F.struct("bin", "n")).alias("h"))
    rows = pairs.select("a", "b").join(held.toDF("a", "ha"), "a").join(held.toDF("b", "hb"), "b")
    place = np.array(directions(bins))
    kinds = dict(rows.dtypes)

    def dominant(counts: np.ndarray) -> np.ndarray:
        left, found = counts.copy(), []
        for _ in range(n):
            k = int(left.argmax())
            if left[k] < max(1, least):
                break
            found.append(k)
            left[max(0, k - 1) : k + 2] = 0
        return place[found]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ca, cb = np.zeros(bins), np.zeros(bins)
                for c, h in ((ca, r["ha"]), (cb, r["hb"])):
                    for x in h:
                        c[x["bin"]] += x["n"]
                fits = []
                for i, j in combinations(dominant(ca), 2):
                    for k, m in permutations(dominant(cb), 2):
                        u, _, vt = np.linalg.svd(np.outer(k, i) + np.outer(m, j))
                        turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
                        onto = (place @ turn.T @ place.T).argmax(1)
                        fits.append((float(np.sqrt(((ca / ca.sum() - cb[onto] / cb.sum()) ** 2).sum())), len(fits), turn.reshape(-1).tolist()))
                out += [(r["a"], r["b"], k, gap, turn) for k, (gap, _, turn) in enumerate(sorted(fits)[:top])]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(cols[0], batch.schema.field("a").type), pa.array(cols[1], batch.schema.field("b").type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.list_(pa.float64()))], names=["a", "b", "rank", "gap", "turn"])

    return rows.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, rank int, gap double, turn array<double>")
