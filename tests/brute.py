"""Plain loops that the Spark jobs are compared with on small data."""

import json

import numpy as np

TYPES = {"general", "preference", "decision", "bug_fix", "pattern"}


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12)


def visible(request, memory):
    wanted = request.get("project_id")
    return request["user_id"] == memory["user_id"] and (
        not wanted or wanted == memory["project_id"]
    )


def nearest(request, memories, k, floor=None):
    rows = [
        (-cosine(request["embedding"], m["embedding"]), m["id"])
        for m in memories
        if m["importance_score"] > 0
        and m["embedding"] is not None
        and any(m["embedding"])
        and visible(request, m)
    ]
    rows = sorted(rows)[:k]
    return [(i, -s) for s, i in rows if floor is None or -s >= floor]


def save_in_order(memories, incoming, floor=0.93):
    """Decisions of saves run one after another."""
    table = [dict(m, origin="stored", rank=(0, m["id"])) for m in memories]
    out = {}
    for row in sorted(incoming, key=lambda r: r["seq"]):
        hits = [
            (-cosine(row["embedding"], m["embedding"]), m["rank"], m)
            for m in table
            if m["importance_score"] > 0 and visible(row, m)
        ]
        hits.sort(key=lambda h: h[:2])
        if hits and -hits[0][0] >= floor:
            best = hits[0][2]
            out[row["seq"]] = (best["origin"], best["rank"][1])
        else:
            out[row["seq"]] = (None, None)
            table.append(dict(row, origin="batch", rank=(1, row["seq"])))
    return out


def pack(results, budget):
    """Ids taken from (rank, id, score, content) under a token budget."""
    left, taken = budget, []
    for rank, memory_id, score, content in sorted(results, key=lambda r: (-r[2], r[0])):
        cost = len(content) // 4
        if cost <= left:
            taken.append(memory_id)
            left -= cost
    return taken


class Spoiled(Exception):
    pass


def _judge(item):
    """(content, type, importance) of a good item, None for a skipped one."""
    if not isinstance(item, dict):
        raise Spoiled
    kind = item.get("memory_type", "general")
    if not isinstance(kind, str) or kind not in TYPES or "content" not in item:
        return None
    score = item.get("importance_score", 0.5)
    if score is None or isinstance(score, (list, dict)):
        raise Spoiled
    try:
        score = float(score)
    except ValueError:
        return None
    content = str(item["content"])
    return (content, kind, score) if content and 0 <= score <= 1 else None


def completion(raw):
    text = raw.strip()
    if text.startswith("```"):
        text = text.split("```")[1].removeprefix("json")
    try:
        found = json.loads(text)
    except ValueError:
        return []
    if not isinstance(found, list):
        return []
    try:
        judged = [_judge(item) for item in found[:5]]
    except Spoiled:
        return []
    return [(i, *j) for i, j in enumerate(judged) if j]
