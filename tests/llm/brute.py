"""Plain versions of the operators, over lists of (doc_id, text)."""

import re


def base_spans(text):
    text, out = text or "", []
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                twice = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(d - 9 if d > 9 else d for d in twice) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def set_components(rows):
    """doc_id to component, for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    lists = {}
    for i, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(i)
    pairs = {(a, b) for members in lists.values() for a in members for b in members if a < b}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(sets, linked)
