"""Suffix arrays by induced sorting, and permuted common prefixes, as whole-array steps.

Suffixes are classified as smaller or larger than their successor; the leftmost-smaller substrings are ranked, and
sorted by recursion on their ranks where ranks repeat; from their order all larger suffixes and then all smaller ones
are induced. Over bytes the induction scans buckets, each suffix being placed once; over ranks (which have too many
buckets to scan) it sorts chains to the next known suffix by doubling.
"""

import numpy as np

#: Alphabets up to here are induced bucket by bucket.
SCANNED = 1 << 10


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0, equal keys sharing one."""
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
    return out


def classified(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; t ends with its only least symbol, whose suffix counts as smaller."""
    n = len(t)
    differs = np.where(t[1:] != t[:-1], np.arange(n - 1), n)
    after = np.minimum.accumulate(differs[::-1])[::-1]
    return np.append((t[:-1] < t[1:])[np.minimum(after, n - 2)], True)


def substring_ranks(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks of substrings of symbols (whole numbers from 1), as many symbols at a time as fit 62 bits."""
    fit = max(1, 62 // bits)
    key = np.zeros(len(starts), np.int64)
    for j in range(fit):
        at = np.minimum(starts + j, len(symbols) - 1)
        key = (key << bits) | np.where(j < lengths, symbols[at], 0)
    longer = np.flatnonzero(lengths > fit)
    ranks = dense(key)
    if len(longer):
        tails = substring_ranks(symbols, starts[longer] + fit, lengths[longer] - fit, bits) + 1
        ranks *= int(tails.max()) + 1
        ranks[longer] += tails
        ranks = dense(ranks)
    return ranks


def induced_by_buckets(t: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """The suffix array from the sorted leftmost-smaller suffixes: one scan up for larger suffixes, one down for smaller."""
    symbols = int(t.max()) + 1
    letters = t.astype(np.uint16)
    bounds = np.searchsorted(t[sorted_lms], np.arange(symbols + 1))
    large: list[list] = [[] for _ in range(symbols)]

    def deal(found: np.ndarray, into: list[list]) -> None:
        of = letters[found]
        order = np.argsort(of, kind="stable")
        of, found = of[order], found[order]
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        for part in np.split(found, cuts):
            into[t[part[0]]].append(part)

    for c in range(symbols):
        new = np.concatenate(large[c]) if large[c] else np.empty(0, np.int64)
        done = [new]
        while len(new):  # predecessors that fall into the same bucket, round by round
            before = new[new > 0] - 1
            new = before[~small[before] & (t[before] == c)]
            done.append(new)
        large[c] = np.concatenate(done)
        scanned = np.concatenate((large[c], sorted_lms[bounds[c] : bounds[c + 1]]))
        before = scanned[scanned > 0] - 1
        before = before[~small[before] & (t[before] > c)]
        if len(before):
            deal(before, large)
    lower: list[list] = [[] for _ in range(symbols)]
    lower[int(t[-1])].append(np.array([len(t) - 1]))
    out = []
    for c in range(symbols - 1, -1, -1):  # arrays run from the bucket's end to its start
        new = np.concatenate(lower[c]) if lower[c] else np.empty(0, np.int64)
        done = [new]
        while len(new):
            before = new[new > 0] - 1
            new = before[small[before] & (t[before] == c)]
            done.append(new)
        mine = np.concatenate(done)
        scanned = np.concatenate((mine, large[c][::-1]))
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[small[before] & (t[before] < c)]
        if len(before):
            deal(before, lower)
    return np.concatenate(out)[::-1]


def induced_by_chains(t: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """The same for large alphabets: a suffix is its chain of like-typed symbols up to a suffix whose rank is known."""
    n = len(t)

    def chains(kind: np.ndarray, known: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Positions of kind in order. known: sorted positions that end the chains; key: symbol and type of each position."""
        rank = np.zeros(n, np.int64)
        rank[known] = np.arange(1, len(known) + 1)
        held = np.flatnonzero(kind | (rank > 0))
        place = np.empty(n + 1, np.int64)
        place[held] = np.arange(len(held))
        ended = rank[held] > 0
        now = dense(key[held] * (len(known) + 1) + rank[held])
        step = np.where(ended, np.arange(len(held)), place[np.minimum(held + 1, n - 1)])
        while True:
            new = dense(now * (len(held) + 1) + now[step])
            stop = ended[step].all()
            now, step = new, step[step]
            if stop:
                break
        order = np.empty(len(held), np.int64)
        order[now] = held  # chains end in known suffixes, so ranks are unique
        return order[kind[order]]

    key = 2 * t + small
    large = chains(~small, sorted_lms, key)
    ends = np.zeros(n, bool)
    ends[1:] = small[:-1] & ~small[1:]
    last = np.array([n - 1])
    lower = small.copy()
    lower[-1] = False
    lower = chains(lower, np.concatenate((last, large[ends[large]])), key)
    both = np.concatenate((last, lower, large))
    # both parts are sorted by symbol; at one symbol the larger suffixes (which fall) come first
    return both[np.argsort(key[both], kind="stable")]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of whole numbers from 0, of which the last is the least and stands there once."""
    t = np.asarray(t, np.int64)
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    small = classified(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    symbols = 2 * t + small + 1
    lengths = np.append(np.diff(lms) + 1, 1)
    names = substring_ranks(symbols, lms, lengths, int(symbols.max()).bit_length())
    if int(names.max()) + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[names] = lms
    else:
        order = lms[suffix_array(names)]
    return induced_by_buckets(t, small, order) if int(t.max()) < SCANNED else induced_by_chains(t, small, order)


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """For each wanted position the length (at most `most` at its start's distance) of the prefix that its suffix shares
    with the one before it in the suffix array; positions that aren't wanted get 0.

    Permuted order: a position whose predecessor continues the same match needs no comparison, its prefix is one
    shorter. The others, beginnings of stretches of wanted positions among them, are compared four symbols (of 16 bits) at
    a time."""
    n = len(sa)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.flatnonzero(wanted)
    phi = before[at]
    left = (at > 0) & (phi > 0)
    same = np.zeros(len(at), bool)
    same[left] = symbols[at[left] - 1] == symbols[phi[left] - 1]
    follows = np.concatenate(([False], at[1:] == at[:-1] + 1)) & same
    follows[1:] &= phi[1:] == phi[:-1] + 1
    heads = np.flatnonzero(~follows)
    padded = np.concatenate((symbols.astype("<u2"), np.zeros(most + 16, "<u2")))
    words = np.ndarray((len(padded) - 3,), "<u8", padded.tobytes(), strides=(2,))
    a, b = at[heads], phi[heads]
    length = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(b >= 0)
    for done in range(0, most, 4):
        x = words[a[live] + done] ^ words[b[live] + done]
        off = x != 0
        length[live[off]] = done + np.bitwise_count((x[off] & (~x[off] + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 16
        live = live[~off]
        if not len(live):
            break
    length[live] = most
    owner = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
    head_of = np.searchsorted(heads, owner)
    out = np.zeros(n, np.int64)
    out[at] = np.maximum(length[head_of] - (at - at[owner]), 0)
    return out
