"""The search rules, one pair at a time, as the tests' yardstick."""

import numpy as np


def unit(v):
    v = np.asarray(v, dtype=np.float64)
    n = np.sqrt((v * v).sum())
    return v / n if n >= 1e-9 else None


def top_k(items, limit, same_file=True, same_title=True, same_author=False, dedup="best",
          predict=None, sources=None):
    """``items``: dicts id, file, title, authors, vec. Returns {(source, candidate): (score, rank)}."""
    rows = [dict(i, unit=unit(i["vec"])) for i in items if i["vec"] is not None]
    rows = sorted((r for r in rows if r["unit"] is not None), key=lambda r: r["id"])
    found = {}
    for s in rows:
        if sources is not None and s["id"] not in sources:
            continue
        pool = []
        for c in rows:
            if same_file and s["file"] is not None and s["file"] == c["file"]:
                continue
            if same_title and s["title"] is not None and s["title"] == c["title"]:
                continue
            if same_author and set(s["authors"]) & set(c["authors"]):
                continue
            score = round(float(s["unit"] @ c["unit"]), 9)
            pool.append((score, c))
        rank_by = [(x, x) for x, _ in pool]
        if predict is not None:
            predicted = [predict(x) for x, _ in pool]
            if predicted and max(predicted) >= 1e-6:
                rank_by = [(p, x) for p, (x, _) in zip(predicted, pool)]
        order = sorted(zip(rank_by, pool), key=lambda p: (-p[0][0], -p[0][1], p[1][1]["id"]))
        if dedup == "first":
            order_ids = sorted(order, key=lambda p: p[1][1]["id"])
            keep = {}
            for p in order_ids:
                keep.setdefault(p[1][1]["title"], p)
            order = [p for p in order if keep[p[1][1]["title"]] is p]
        kept, seen = [], set()
        for (score, _), (_, c) in order:
            key = (c["title"], tuple(sorted(c["authors"])))
            if dedup == "best":
                if key in seen:
                    continue
                seen.add(key)
            kept.append((score, c))
        for rank, (score, c) in enumerate(kept[:limit], 1):
            found[s["id"], c["id"]] = (score, rank)
    return found
