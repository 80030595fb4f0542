"""The same results, computed plainly in one process."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    """The base kinds by the definition: find, then drop what is too short."""
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
        ("access", r"AKIA[A-Z0-9]+", 18, 0),
        ("hex", r"[0-9a-f]+", 16, 0),
    ]
    found = []
    for place, (kind, pattern, least, group) in enumerate(kinds):
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        for m in re.finditer(pattern, text, flags):
            if len(m[group]) >= least:
                found.append((m.start(), place, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def tokens(texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def piece_ids(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = library.encode(list(texts))
    return [(i, library.decode(i)) for i in ids]


def bucket_counts(data):
    """Three triplets of each window of four bytes, hashed into 128 buckets."""
    counts, whole = [0] * 128, 0xFFFFFFFF
    for i in range(len(data) - 3):
        for kind, places in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3)]):
            a, b, c = (data[i + p] for p in places)
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 & whole) ^ (c * 0xC2B2AE3D + 0x27D4EB2F * kind & whole)
            h = (h ^ h >> 15) * 0x2C1B3C6D & whole
            counts[h >> 25] += 1
    return counts


def quartiles(counts):
    ordered = sorted(counts)
    return [sum(n > ordered[border] for border in (31, 63, 95)) for n in counts]


def length_step(size):
    return min(255, round(math.log(size + 1) / math.log(1.25)))


def fingerprint(data):
    bits = "".join(f"{q:02b}" for q in quartiles(bucket_counts(data)))
    return f"{length_step(len(data)):02x}{int(bits, 2):064x}"


def likeness(a, b):
    apart = sum(abs((int(a[2:], 16) >> 2 * k & 3) - (int(b[2:], 16) >> 2 * k & 3)) for k in range(128))
    return 1.0 - (apart + min(24, abs(int(a[:2], 16) - int(b[:2], 16)))) / (128 * 3 + 24)


def fingerprints(rows):
    """Rows of (id, text), ids unique: edited texts, digests and likenesses by id."""
    rows = sorted(rows, reverse=True)
    found = {}
    for at, (doc_id, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, nxt = (fingerprint(t.encode()) for t in (text, edited, following))
        found[doc_id] = (len(text), sha(edited), own, changed, likeness(own, changed), likeness(own, nxt))
    return found


def gram_set(text):
    words = WORD.findall(text.translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similar_components(rows):
    """Rows of (key, text): set size and the smallest key reachable by links."""
    sets = {key: gram_set(text) for key, text in rows}
    holders = defaultdict(list)
    for key, s in sets.items():
        for gram in s:
            holders[gram].append(key)
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    for key, s in sets.items():
        shared = Counter(other for gram in s for other in holders[gram] if other < key)
        for other, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                a, b = find(key), find(other)
                root[max(a, b)] = min(a, b)
    return {key: (len(s), find(key)) for key, s in sets.items()}


FIELD = "<*>"


def tells(constant, size):
    """Whether a template with so many constant words stands for its lines."""
    return constant >= 8 and 2 * constant >= size


def form_of(line):
    """The words by which a line repeats others, and whether its fields are left out."""
    words = WORD.findall(line)
    masked = tuple(FIELD if re.search("[0-9]", w) else w for w in words)
    if tells(sum(w != FIELD for w in masked), len(masked)):
        return masked, True
    return tuple(words), False


def one_template(a, b):
    same = [x for x, y in zip(a, b) if x == y]
    return 10 * len(same) >= 8 * len(a) and tells(sum(x != FIELD for x in same), len(a))


def kept_lines(rows):
    """Rows of (key, text): n_lines, n_dropped and the text that is left, by key."""
    holders, leaves = defaultdict(set), defaultdict(set)
    for key, text in rows:
        for line in text.split("\n"):
            form, of_template = form_of(line)
            if form:
                holders[form].add(key)
                if of_template:
                    leaves[(len(form), *form[:3])].add(form)
    seed_of = {}
    for forms in leaves.values():
        seeds = []
        for form in sorted(forms, key=lambda f: xxhash.xxh3_128_digest(" ".join(f).encode())):
            seed_of[form] = next((s for s in seeds if one_template(form, s)), form)
            if seed_of[form] == form:
                seeds.append(form)
    documents = defaultdict(set)
    for form, keys in holders.items():
        documents[seed_of.get(form, form)] |= keys
    found = {}
    for key, text in rows:
        lines = text.split("\n")
        forms = [form_of(line)[0] for line in lines]
        dropped = [bool(f) and key != min(documents[seed_of.get(f, f)]) for f in forms]
        left = "\n".join(line for line, gone in zip(lines, dropped) if not gone)
        found[key] = (sum(map(bool, forms)), sum(dropped), left)
    return found
