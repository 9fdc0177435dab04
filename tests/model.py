"""The operators on plain lists of (time, value), as the specification of the DataFrame forms. Times are milliseconds or None."""

from __future__ import annotations


def keep(p, s):
    return [(t, v) for t, v in s if v is None or p(v)]


def transform(f, s):
    return [(t, None if v is None else f(v)) for t, v in s]


def keep_acc(f, acc, p, s):
    out = []
    for t, v in s:
        if v is None or p(v, acc):
            out.append((t, v))
        acc = acc if v is None else f(acc, v)
    return out


def scan(f, acc, s):
    out = []
    for t, v in s:
        acc = acc if v is None else f(acc, v)
        out.append((t, None if v is None else acc))
    return out


def flat(s):
    return [(t, x) for t, v in s for x in ([None] if v is None else v)]


def nested(windows):
    return [(w[0][0] if w else None, [v for _, v in w if v is not None]) for w in windows]


def sliding(n, s):
    s = [e for e in s if e[1] is not None]
    return [s[i : i + n] for i in range(len(s))]


def chop(n, s):
    s = [e for e in s if e[1] is not None]
    return [s[i : i + n] for i in range(0, len(s), n)]


def sliding_time(ms, s):
    s = [e for e in s if e[0] is not None]
    out = []
    for i, (t, _) in enumerate(s):
        end = next((j for j in range(i, len(s)) if s[j][0] >= t + ms), len(s))
        out.append(s[i:end])
    return out


def chop_time(ms, s):
    s = [e for e in s if e[0] is not None]
    out, edge = [], s[0][0] + ms if s else 0
    while s:
        n = next((j for j, e in enumerate(s) if e[0] >= edge), len(s))
        out.append(s[:n])
        s, edge = s[n:], edge + ms
    return out


def complete(s):
    return [s]


def zipped(a, b):
    a, b = ([e for e in s if e[1] is not None] for s in (a, b))
    return [(x[0], (x[1], y[1])) for x, y in zip(a, b)]


def merged(streams):
    def two(a, b):
        out = []
        while a and b:
            if a[0][0] is not None and b[0][0] is not None and b[0][0] <= a[0][0]:
                out.append(b[0])
                a, b = b[1:], a
            else:
                out.append(a[0])
                a, b = b, a[1:]
        return out + a + b

    out = streams[-1]
    for s in reversed(streams[:-1]):
        out = two(s, out)
    return out
