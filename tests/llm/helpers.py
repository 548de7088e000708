"""Small tables and plain brute-force versions the operators are held against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

DOCS = "doc_id long, text string, source string, key string, sha string, kept_id int"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    rnd = random.Random(seed)
    words = text.split(" ")
    for k in rnd.sample(range(len(words)), int(len(words) * share)):
        words[k] = f"new{seed}{k}"
    return " ".join(words)


def documents(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 2}", "k", "x", 7) for i, t in rows], DOCS)


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, threshold=80):
    """(n_shingles, component) per row of (doc_id, text), doc_ids distinct."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    ra, rb = find(a), find(b)
                    up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


KINDS = [
    ("assign", re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute_secrets(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]
