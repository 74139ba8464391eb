"""The passes as plain loops over small ledgers, to hold the Spark plans against."""

from itertools import combinations


def norm(ref, case=False):
    kept = "".join(c for c in ref or "" if c.isascii() and c.isalnum())
    return kept if case else kept.lower()


def days(x, y):
    return -1 if x is None or y is None else abs((x - y).days)


def near(x, y, cfg):
    d = abs(x - y)
    p, f = d <= max(x, y) * cfg.amount_tolerance_percent, d <= cfg.amount_tolerance_fixed
    return {"percent": p, "fixed": f, "both": p or f}[cfg.amount_tolerance_mode]


def exact(a, b, cfg):
    free = {}
    key = lambda e: (e["date"], int(e["amount_abs"] * 100 + 0.5), "" if cfg.ignore_reference_in_exact else norm(e["ref_number"]))
    for e in b:
        free.setdefault(key(e), []).append(e)
    out = []
    for e in a:
        queue = free.get(key(e), [])
        if not queue or e["date"] is None:
            continue
        o = queue[0]
        p, q = e["ref_number"], o["ref_number"]
        if p and q and not (norm(p, cfg.case_sensitive_ref) == norm(q, cfg.case_sensitive_ref) != ""):
            continue
        out.append((e["id"], o["id"]))
        queue.pop(0)
    return out


def amount_date(a, b, cfg):
    used, out, several = set(), [], []
    for e in a:
        x = e["amount_abs"]
        c = [o for o in b if o["id"] not in used and near(x, o["amount_abs"], cfg) and o["amount_abs"] <= x + max(x * cfg.amount_tolerance_percent, cfg.amount_tolerance_fixed) and days(e["date"], o["date"]) <= cfg.date_tolerance_days]
        if len(c) == 1:
            used.add(c[0]["id"])
            out.append((e["id"], c[0]["id"]))
        elif c:
            several += [(e["id"], i, o["id"]) for i, o in enumerate(sorted(c, key=lambda o: (o["amount_abs"], o["row_index"])))]
    return out, several


def subset(target, amounts, tolerance, most):
    """The first of the best sums, by listing all of them.

    Sets are tried in lexicographic order of their indexes; one that has a set within tolerance as its beginning is not tried, and nothing is after one within a cent.
    """
    tried = sorted(c for n in range(2, most + 1) for c in combinations(range(len(amounts)), n))
    best, off, ended = None, float("inf"), []
    for c in tried:
        rests = [target]
        for i in c:
            rests.append(rests[-1] - amounts[i])
        if any(c[: len(e)] == e for e in ended) or any(amounts[i] > r + tolerance for i, r in zip(c, rests)):
            continue
        if abs(rests[-1]) <= tolerance:
            ended.append(c)
            if abs(rests[-1]) < off:
                best, off = list(c), abs(rests[-1])
                if off < 0.01:
                    break
    return best


def splits(a, b, cfg):
    out, used = [], set()

    def way(single, multi, side):
        for e in single:
            if e["id"] in used or e["amount_abs"] < 1:
                continue
            c = [o for o in multi if o["id"] not in used and o["amount_abs"] <= e["amount_abs"] + cfg.amount_tolerance_fixed and days(e["date"], o["date"]) <= cfg.date_tolerance_days]
            c = sorted(c, key=lambda o: -o["amount_abs"])[: cfg.split_pool]
            if len(c) < 2:
                continue
            tol = max(cfg.amount_tolerance_fixed, e["amount_abs"] * cfg.amount_tolerance_percent)
            found = subset(e["amount_abs"], [o["amount_abs"] for o in c], tol, cfg.split_max_entries)
            if found:
                ids = [c[i]["id"] for i in found]
                used.update([e["id"], *ids])
                out.append(([e["id"]], ids) if side == "A" else (ids, [e["id"]]))

    way(a, b, "A")
    way(b, a, "B")
    return out
