"""Brute-force versions of the operators, in plain Python."""

import collections
import hashlib
import math
import re
import zlib


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaks(docs, items, window=10):
    """doc_id, text / item_id, text -> {doc_id: (n_words, n_hit, items)}."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out[d] = (len(w), len(hit), sorted(found, key=lambda x: (x is None, x or 0)))
    return out


def near(docs):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    inverted = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    common = collections.Counter((a, b) for ds in inverted.values() for i, b in enumerate(ds) for a in ds[:i])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def substrings(docs, length=200):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] in order."""
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = collections.Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def secrets(text):
    """Base spans as (start, kind, end)."""
    text, out = text or "", []
    assign = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group(0)) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group(0)) >= 24]
    return sorted(out)


def line_measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    own = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(hit)


def languages(docs, smoothing=0.5, buckets=1 << 15):
    """[(doc_id, text, lang)] -> {doc_id: (held_out, lang_pred)}: naive Bayes over dictionaries of the same hashed n-grams."""
    mask = (1 << 64) - 1

    def mix(x):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ x >> 33) * c) & mask
        return x ^ x >> 33

    def grams(text):
        low = [(y if len(y := x.lower()) == 1 else x) if x.isalpha() else " " for x in text or ""]
        out = collections.Counter()
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                h = ord(low[i]) + 1
                for k in range(1, n):
                    h = (h * 0x9E3779B97F4A7C15 + ord(low[i + k]) + k + 1) & mask
                out[mix(h) * buckets >> 64] += 1
        return out

    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in docs}
    train = [(t, lang) for d, t, lang in docs if not held[d] and lang is not None]
    counts, n = collections.defaultdict(collections.Counter), collections.Counter(lang for _, lang in train)
    for t, lang in train:
        counts[lang] += grams(t)
    whole = {lang: sum(counts[lang].values()) + smoothing * buckets for lang in n}
    out = {}
    for d, t, _ in docs:
        if not any(c.isalpha() for c in t or "") or not n:
            out[d] = (held[d], "und")
            continue
        g = grams(t)
        score = {lang: math.log(n[lang] / len(train)) + sum(k * math.log((counts[lang][b] + smoothing) / whole[lang]) for b, k in g.items()) for lang in sorted(n)}
        out[d] = (held[d], max(sorted(score), key=score.get))
    return out


def co_trained(content, meta, y, order, rounds=4, confident=0.97, aside_every=4, steps=12, gain=1e-4):
    """Scores of all rows by co-training with dense matrices: ``y`` is NaN without a label, ``order`` the labelled rows in the sample's order."""
    import numpy as np

    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -35, 35)))
    views = [np.asarray(content, float), np.asarray(meta, float)]
    held = np.arange(len(order)) % aside_every == 0
    train, aside, pool = order[~held], order[held], np.flatnonzero(np.isnan(y))
    scaled = []
    for x in views:
        base = x[np.concatenate([train, pool])]
        mean, dev = base.mean(axis=0), base.std(axis=0)
        z = np.where(dev > 1e-6, (x - mean) / np.where(dev > 1e-6, dev, 1), 0)
        scaled.append(np.hstack([z, np.ones((len(x), 1))]))

    def newton(z, t, w, ridge, most=steps, enough=gain):
        penalty = np.append(np.full(z.shape[1] - 1, ridge), 1e-6)
        best = None
        for _ in range(most):
            at = np.clip(z @ w, -35, 35)
            p = sigmoid(at)
            loss = np.sum(np.logaddexp(0, at) - t * at) + 0.5 * penalty @ (w * w)
            if best is not None and loss > best[0]:
                w = (w + best[1]) / 2
                continue
            grad = z.T @ (p - t) + penalty * w
            hess = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
            best, step = (loss, w), np.linalg.solve(hess, grad)
            w = w - step
            if grad @ step / 2 < enough * (1 + loss):
                return w
        return best[1]

    def calibration(x, t, ridge):
        mean, dev = x.mean(axis=0), x.std(axis=0)
        z = np.hstack([(x - mean) / np.where(dev > 1e-6, dev, np.inf), np.ones((len(x), 1))])
        w = newton(z, t, np.zeros(z.shape[1]), ridge, enough=1e-15)
        return lambda v: np.hstack([(v - mean) / np.where(dev > 1e-6, dev, np.inf), np.ones((len(v), 1))]) @ w

    weights = [newton(z[train], y[train], np.zeros(z.shape[1]), 1.0) for z in scaled]
    said = [[], []]
    for _ in range(rounds):
        for k in (0, 1):
            logit = scaled[k] @ weights[k]
            said[k].append(sigmoid(calibration(logit[aside][:, None], y[aside], 1e-3)(logit[:, None])))
        new = []
        for k in (0, 1):
            p = np.array(said[1 - k])[:, pool]
            sure = np.maximum(p, 1 - p) >= confident
            first = sure.argmax(axis=0)
            has = sure.any(axis=0)
            label = (p[first, np.arange(len(pool))] > 0.5).astype(float)
            rows = np.concatenate([train, pool[has]])
            new.append(newton(scaled[k][rows], np.concatenate([y[train], label[has]]), weights[k], 1.0))
        weights = new
    both = []
    for k in (0, 1):
        logit = scaled[k] @ weights[k]
        both.append(calibration(logit[aside][:, None], y[aside], 1e-2)(logit[:, None]))
    both = np.column_stack(both)
    return sigmoid(both[:, 0]), sigmoid(both[:, 1]), sigmoid(calibration(both[aside], y[aside], 1e-1)(both))


def audit(docs, min_docs=3, top=200):
    """{(lang, source, part, item): (value, rank)} densely, from (lang, source, text) rows."""
    docs = [(a or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))) for a, s, t in docs]
    out = {}
    for lang in {a for a, *_ in docs}:
        own = [(s, w) for a, s, w in docs if a == lang]
        df = collections.Counter(x for _, w in own for x in set(w))
        kept = sorted(x for x, n in df.items() if n >= min_docs)
        counts = {s: collections.Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(x for x in w if df[x] >= min_docs)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept)) for x in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = [(sum(gap(p[s][x], p[o][x]) for x in kept), o) for o in counts if o != s]
            terms = [(gap(p[s][x], q[x]), x) for x in kept if counts[s][x] and p[s][x] > q[x]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most]
                out |= {(lang, s, part, item): (v, k) for k, (v, item) in enumerate(rows, 1)}
    return out


def variants(docs, least=5, often=3, times=2):
    """{word: (form, root, n, n_near, form_n)} from (doc_id, text) rows, by comparing each word with all that it could be one letter away from."""
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}
        near[w] = (edits & n.keys()) - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out
