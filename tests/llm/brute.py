"""What the operators compute, one document or pair at a time."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_brute(docs):
    sets = {i: sets_of(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def base_stats(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def clause_brute(text, classes, weights, reach=3, bare=0.25):
    """Weights by kind of a text: its lines, their clauses, and each insult or threat by what stands around it."""
    kinds = dict.fromkeys(("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat", "negated threat", "reported threat"), 0.0)
    for line in text.lower().replace("\u2019", "'").replace("\u201c", '"').replace("\u201d", '"').split("\n"):
        marks = re.findall(r"""[a-z\x80-\uffff]+|["'.!?;]""", line)
        quotes = [i for i, m in enumerate(marks) if m == '"']
        quotes = set(quotes[: len(quotes) // 2 * 2])
        clauses, inside = [[]], False
        for i, m in enumerate(marks):
            if m in (".", "!", "?", ";"):
                clauses.append([])
            elif i in quotes:
                inside = not inside
            elif m not in ("'", '"'):
                c = classes.get(m)
                if m == "t" and i > 1 and marks[i - 1] == "'" and marks[i - 2].endswith("n") or m == "n" and marks[i + 1 : i + 2] == ["'"]:
                    c = "negation"
                elif m == "t" and marks[i + 1 : i + 2] == ["'"] and marks[i - 1] != "'":
                    c = "target"
                clauses[-1].append((c, weights.get(m, 0.0), inside))
        for words in clauses:
            said = [c for c, _, _ in words]
            for i, (c, w, quoted) in enumerate(words):
                if c in ("insult", "threat"):
                    w *= bare if c == "threat" and "intent" not in said[:i] else 1
                    how = "reported " if quoted or "report" in said[:i] else "negated " if "negation" in said[max(0, i - reach) : i] else "aimed " if "target" in said else ""
                    kinds[how + c] += w
    return list(kinds.values())
