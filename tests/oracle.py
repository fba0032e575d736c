"""A second, row-at-a-time reading of the estimator's rules, for comparison only."""

import statistics as st

TIER = {1: 1.0, 2: 0.6, 3: 0.25}


def mad(xs):
    m = st.median(xs)
    return st.median([abs(x - m) for x in xs])


def votes(quotes):
    by = {}
    for provider, price, tier in quotes:
        by.setdefault(provider, []).append((price, tier))
    out = {}
    for p, rows in by.items():
        prices = [x for x, _ in rows]
        m = st.median(prices)
        out[p] = {"price": m, "n": len(rows), "tier": min(t for _, t in rows), "spread": mad(prices) * 1.4826 / m if m > 0 else 0.0}
    return out


def screened(v):
    prices = [a["price"] for a in v.values()]
    if len(prices) < 4:
        return set()
    m, d = st.median(prices), mad(prices)
    if d == 0:
        return {p for p, a in v.items() if m > 0 and a["price"] > 0 and max(a["price"] / m, m / a["price"]) > 3 * (1 + 1e-9)}
    return {p for p, a in v.items() if abs(a["price"] - m) / (d * 1.4826) > 3}


def capped(tiers, cap=0.35):
    w = {p: TIER[t] for p, t in tiers.items()}
    if len(w) * cap < 1:
        return w
    for _ in range(len(w)):
        total = sum(w.values())
        over = [p for p in w if w[p] / total > cap]
        if not over:
            break
        start = dict(w)
        for p in over:
            w[p] = min(start[p], cap * (total - start[p]) / (1 - cap))
    return w


def value(quotes, band=1.0):
    v = votes(quotes)
    live = {p: a for p, a in v.items() if p not in screened(v)}
    if not live:
        return None
    w = capped({p: a["tier"] for p, a in live.items()})
    if band >= 1:
        return sum(live[p]["price"] * w[p] for p in live) / sum(w.values())
    cast = []
    for p, a in live.items():
        s = min(max(a["spread"], 0.03), 0.5)
        cast += [(a["price"] * k, w[p] / 3) for k in (1 - s, 1, 1 + s)]
    total, at, num, mass = sum(x for _, x in cast), 0.0, 0.0, 0.0
    for price, x in sorted(cast):
        inside = min(at + x, (1 + band) / 2 * total) - max(at, (1 - band) / 2 * total)
        at += x
        if inside > 0:
            num, mass = num + inside * price, mass + inside
    return num / mass


def dispersion(quotes):
    v = votes(quotes)
    prices = [a["price"] for p, a in v.items() if p not in screened(v)]
    return mad(prices) * 1.4826 / st.median(prices) if len(prices) >= 3 else None
