"""What the operators should give, worked out plainly in Python."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np

from quadrille.llm import language_id

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def spaced(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def plain_licenses(text):
    words, places = alnum(text), []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    places.sort()
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = spaced(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return collections.Counter((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def plain_phrases(text, sample):
    """Greedy longest matches by substring search, in blocks."""
    count = 0
    for at in range(0, len(text), language_id.BLOCK):
        block, k = text[at : at + language_id.BLOCK], 0
        while k < len(block):
            n = 1
            while k + n < len(block) and block[k : k + n + 1] in sample:
                n += 1
            count, k = count + 1, k + n
    return count


def plain_quality(text):
    text = text or ""
    words = spaced(text, False)
    lines = [x for x in text.split("\n") if spaced(x)]
    seen = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    repeated = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed


def plain_contamination(rows, items, size=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(len(w) - size, 0) + 1):
            if w:
                windows[tuple(w[k : k + size])].add("null" if i is None else str(i))
    lengths = {len(w) for w in windows}
    out = collections.Counter()
    for i, t in rows:
        w, hit, held = alnum(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    held |= windows[x]
        out[i, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)] += 1
    return out


def plain_notices(text, index):
    """(template, first word, score) of the notices, aligned at every offset of the text, cell by cell."""
    words, out = [int(w) for w in index_words(text, index)], []
    for t, (template, notice) in enumerate(zip(index.templates, index.notices, strict=True)):
        if template.share == 1:
            n = len(notice.words)
            out += [(t, k, 1.0) for k in range(len(words) - n + 1) if words[k : k + n] == notice.words.tolist()]
            continue
        n, slack, good = len(notice.words), notice.slack, []
        if sum(index.idf[w] for w in notice.words.tolist() if w in set(words)) < 0.999 * template.share * index.total[t]:
            continue
        for d in range(-n, len(words) + 1):
            holds = lambda k, key: k >= 0 and (words[k : k + len(key)] == key or any(words[k : k + j] == key[:j] and words[k + j + 1 : k + len(key) + 1] == key[j:] for j in range(1, len(key))))
            key_at = lambda place, key, d=d: any(holds(d + place + x, key.tolist()) for x in range(-slack, slack + 1))
            if not all(key_at(place, key) for place, key in notice.keys):
                continue
            best = {}
            for q in range(-1, n):
                for p in range(d + q - slack - 1, d + q + slack + 1):
                    if q < 0 or p < d + q - slack:
                        best[q, p] = 0.0 if q < 0 else best.get((q - 1, p), 0.0)
                        continue
                    hit = 0 <= p < len(words) and words[p] == notice.words[q]
                    before = max((best[q - 1, x] for x in range(d + q - 1 - slack - 1, p + 1) if (q - 1, x) in best), default=0.0)
                    apart = max((best[q - 1, x] for x in range(d + q - 1 - slack - 1, p) if (q - 1, x) in best), default=0.0)
                    best[q, p] = max(before, best[q, p - 1], apart + index.idf[notice.words[q]] if hit else 0.0)
            score = min(max(v for (q, _), v in best.items() if q == n - 1) / index.total[t], 1.0)
            if score >= template.share:
                good.append((d, score))
        runs = []
        for d, score in good:
            if runs and d - runs[-1][-1][0] <= 2 * slack + 1:
                runs[-1].append((d, score))
            else:
                runs.append([(d, score)])
        for run in runs:
            most = max(x for _, x in run)
            best = [d for d, x in run if x >= most - 1e-9]
            out.append((t, max((best[0] + best[-1]) // 2, 0), most))
    return out


def index_words(text, index):
    """Vocabulary numbers of the words of a text, -1 for others."""
    from quadrille.llm.license_scan import word_hashes

    number = {h: k for k, h in enumerate(index.vocabulary.tolist())}
    return [number.get(h, -1) for w in alnum(text) for h in word_hashes(w).tolist()]


def plain_lm(rows):
    """Scores of rows (id, text) by counting n-grams one by one, with the weights that the model's expectation-maximisation gives for the same events."""
    from quadrille.llm import lm_scoring as lm

    docs = [(lm.fold_of(i), ["<start>", *spaced(t), "</end>"]) for i, t in rows]
    # a word may look like a mark; tell them apart
    docs = [(f, [("mark", w[0]), *(("word", x) for x in w[1:-1]), ("mark", w[-1])]) for f, w in docs]

    def counts(folds):
        one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
        for f, w in docs:
            if f in folds:
                one.update(w[1:])
                before.update(w[:-1])
                two.update(itertools.pairwise(w))
        return one, two, before

    train, main = counts(set(range(1, 10))), counts(set(range(2, 10)))
    total, total_main = sum(train[0].values()), sum(main[0].values())
    events = [(a, b) for f, w in docs if f == 1 for a, b in itertools.pairwise(w)]
    context = lambda table, a: table[2][a] if a == docs[0][1][0] else table[0][a]
    before = np.array([context(main, a) for a, _ in events], np.int64)
    two = np.array([main[1][e] for e in events]) / np.maximum(before, 1)
    one = np.array([main[0][b] for _, b in events]) / max(total_main, 1)
    cells, n = np.unique((lm.context_bucket(before) * lm.CELLS + lm.cell_of(two)) * lm.CELLS + lm.cell_of(one), return_counts=True)
    weights = lm.learn_weights(cells.astype(np.int64), n.astype(float), 1 / (len(main[0]) + 1))
    out = []
    for _, w in docs:
        score = 0.0
        for a, b in itertools.pairwise(w):
            c = context(train, a)
            x = weights[lm.context_bucket(np.array([c]))[0]]
            score += math.log10(x[0] * train[1][a, b] / max(c, 1) + x[1] * train[0][b] / max(total, 1) + x[2] / (len(train[0]) + 1))
        out.append(score)
    return out


def plain_clean(rows, min_docs=5, max_percent=8):
    """(id, text) of the rows (id, text, host) that the quality rules keep, without the frequent lines of their host."""
    normal = lambda line: re.sub("[ \\t\\x0b\\x0c\\r]+", "", line).lower()
    docs, holders = collections.defaultdict(set), collections.defaultdict(set)
    for i, text, host in rows:
        docs[host].add(i)
        for line in (text or "").split("\n"):
            if normal(line):
                holders[host, normal(line)].add(i)
    frequent = {k for k, ids in holders.items() if len(ids) > min_docs and 100 * len(ids) > max_percent * len(docs[k[0]])}
    out = []
    for i, text, host in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if (host, normal(x)) not in frequent]
        chars, kept = (sum(len(normal(x)) for x in y) for y in (lines, left))
        if not plain_quality(text)[-1] and 100 * kept >= 20 * chars:
            out.append((i, "\n".join(left)))
    return out
