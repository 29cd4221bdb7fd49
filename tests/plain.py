"""The published update and the metrics in plain Python, to check the Spark jobs against."""

import math


def clip(p):
    return 0.0000000000001 if p == 0 else 0.999999999999 if p == 1 else p


def prob(margin):
    try:
        return clip(1 / (1 + math.exp(-margin)))
    except OverflowError:
        return 0.0000000000001


def weight(z, n, c):
    if abs(z) <= c.l1:
        return 0.0
    shrunk = z - c.l1 if z > 0 else z + c.l1
    return -shrunk / ((c.beta + math.sqrt(n)) / c.alpha + c.l2)


def counted(p, n):
    return p * n / (p + n) if p + n else 0.0


def batch_step(state, batch, c, use_counts=False):
    """state: feature -> dict(z, n, p, m); batch: list of (label, {feature: value})."""
    g, q, pos, neg = {}, {}, {}, {}
    for y, x in batch:
        margin = sum(weight(state[f]["z"], state[f]["n"], c) * v for f, v in x.items() if f in state)
        d = prob(margin) - y
        for f, v in x.items():
            g[f] = g.get(f, 0.0) + d * v
            q[f] = q.get(f, 0.0) + (d * v) ** 2
            pos[f] = pos.get(f, 0) + y
            neg[f] = neg.get(f, 0) + 1 - y
    out = {f: dict(s) for f, s in state.items()}
    for f in g:
        s = out.setdefault(f, {"z": 0.0, "n": 0.0, "p": 0.0, "m": 0.0})
        w = weight(s["z"], s["n"], c)
        s["p"] += pos[f]
        s["m"] += neg[f]
        n = counted(s["p"], s["m"]) if use_counts else s["n"] + q[f]
        s["z"] += g[f] + c.sigma_sign * (math.sqrt(n) - math.sqrt(s["n"])) / c.alpha * w
        s["n"] = n
    return out


def sequential(state, rows, c, use_counts=False):
    for row in rows:
        state = batch_step(state, [row], c, use_counts)
    return state


def metrics(scored, threshold=0.5):
    """(loss, accuracy, auc) of (label, prob, loss) rows."""
    n = len(scored)
    loss = sum(s[2] for s in scored) / n
    accuracy = sum((s[1] >= threshold) == (s[0] == 1) for s in scored) / n

    def rate(k, label):
        of = [s for s in scored if s[0] == label]
        return sum(s[1] >= k / 10 for s in of) / len(of) if of else 0.0

    auc = sum((rate(k + 1, 1) + rate(k, 1)) / 2 * (rate(k, 0) - rate(k + 1, 0)) for k in range(10))
    return loss, accuracy, auc
