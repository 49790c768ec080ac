"""The visibility rule, row by row."""

import random

LEAST, MOST = -(2**63), 2**63 - 1


def visible(inserts, deletes, snapshot=MOST):
    """inserts: (seq, ts, rid); deletes: (seq, t1, t2 or None)."""
    return sorted(
        (seq, ts, rid) for seq, ts, rid in inserts
        if seq <= snapshot and not any(t1 <= ts and (t2 is None or ts < t2) and seq < s <= snapshot for s, t1, t2 in deletes)
    )


def random_ops(seed, n=400, span=1000):
    """Inserts and deletes in one sequence: 3 in 100 deletes, half of them over deleted ranges, prefixes and open ends too, timestamps at both ends of the range."""
    r = random.Random(seed)
    inserts, deletes = [], []
    for seq in range(1, n + 1):
        if r.random() < 0.08:
            if deletes and r.random() < 0.5:
                _, a, b = r.choice(deletes)
                a = max(a, -span) + r.randint(-20, 20)
                deletes.append((seq, a, a + r.randint(1, 200)))
            elif r.random() < 0.2:
                deletes.append((seq, LEAST, r.randint(-span, 0)))
            elif r.random() < 0.15:
                deletes.append((seq, r.randint(0, span), None))
            else:
                a = r.randint(-span, span)
                deletes.append((seq, a, a + r.randint(1, 300)))
        else:
            ts = r.choice([LEAST, MOST, -1, 0, 1]) if r.random() < 0.03 else r.randint(-span, span)
            inserts.append((seq, ts, seq * 10))
    return inserts, deletes
