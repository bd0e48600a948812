"""Plain versions of what the operators compute, for small inputs."""

import itertools
import re


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def repeated_words(words, width):
    """Words in windows of so many words that occur twice or more."""
    windows = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
    again = {w for w in windows if windows.count(w) > 1}
    return len({k + j for k, w in enumerate(windows) if w in again for j in range(width)})


def shingles(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard_components(rows):
    """doc_id -> the smallest id that links of 0.75 or more reach."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}
