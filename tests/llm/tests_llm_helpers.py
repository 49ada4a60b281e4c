"""Plain versions that several tests share."""


def host_rates_by_hand(rows):
    """Failure rates of (host, failed) rows by host, shrunk with a beta prior of beta-binomial moments."""
    n, x = {}, {}
    for h, bad in rows:
        n[h] = n.get(h, 0) + 1
        x[h] = x.get(h, 0) + bad
    total, k = sum(n.values()), len(n)
    p = sum(x.values()) / total
    observed = sum(n[h] * (x[h] / n[h] - p) ** 2 for h in n)
    pq, room = p * (1 - p), total - sum(v * v for v in n.values()) / total - (k - 1)
    c = min(1.0, max(0.0, (observed - pq * (k - 1)) / (pq * room))) if pq > 0 and room > 0 else 0.0
    if c == 0:
        return dict.fromkeys(n, p)
    size = (1 - c) / c  # rows that the prior is worth
    return {h: (x[h] + p * size) / (n[h] + size) for h in n}
