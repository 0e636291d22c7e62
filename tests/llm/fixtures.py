"""Small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, size string"


def rows(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(200)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice((1, 4, 5, 30, 120, 300)))]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        if i % 5 == 0:
            lines.append(passage)
        texts.append("\n".join(lines))
    base = " ".join(rnd.choice(vocabulary) for _ in range(150)).split()
    for i in range(12):  # near copies
        copy = list(base)
        copy[rnd.randrange(len(copy))] = f"edit{i}"
        texts.append(" ".join(copy))
    texts += [texts[3], texts[3].upper(), None, "", "   ", "\n\n", "x " * 3000, "É ß Ünï\tcode\x0bword", "a" * 5000, texts[-1]]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, len(t or ""), "other", 1, None) for i, t in enumerate(texts)]
    return out + [out[5], (None, texts[7], "en", "s1", 1, None, None, None)]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
