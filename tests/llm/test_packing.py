import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import packing, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcéßÀŒ œ'ſK İΣσςñ́ \x85\x1c\x00\t\n.,!?&%$1²½x's 're don't 中文日本 ﬁ​😀İi̇ªº×÷<|endoftext|>Ǆ"


def test_same_ids_as_the_tokenizer():
    own, whole, rng = wordbpe.WordBpe(PATH), Tokenizer.from_file(PATH), random.Random(1)
    vocabulary = [t.replace("</w>", "") for t in whole.get_vocab()]
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    texts += [" ".join(rng.choice(["The", "dog.", "isn't", "3.14,", "a..b", 'say ".', "é,è"]) for _ in range(30)) for _ in range(300)]
    for t, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own(t) == wordbpe.packed(e.ids), t


def check_plan(histogram, capacity):
    plan = packing.best_fit(histogram, capacity)
    numbers, tokens, count, cost = defaultdict(list), Counter(), Counter(), Counter()
    at = defaultdict(list)
    for length, first, many, sequence, offset in plan:
        numbers[length] += range(first, first + many)
        for s in range(sequence, sequence + many):
            tokens[s] += length
            count[s] += 1
            cost[s] += length**2
            at[s].append((offset, length))
    limits = capacity.limits()
    assert {k: len(v) for k, v in numbers.items()} == histogram and all(sorted(v) == list(range(len(v))) for v in numbers.values())
    assert max(tokens.values()) <= limits[0] and max(count.values()) <= limits[1] and max(cost.values()) <= limits[2]
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
    return len(tokens)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plans_hold_every_capacity(rule):
    rng = random.Random(2)
    for _ in range(20):
        histogram = dict(Counter(min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(500)))
        check_plan(histogram, packing.Capacity(100, 7, 4000 + 6000, (1.0, 0.3, 0.5), rule))
        used = check_plan(histogram, packing.Capacity(100))
        assert used <= 1.03 * -(-sum(k * n for k, n in histogram.items()) // 100) + 1


def naive_best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            k = min(fits, key=lambda k: (free[k], k))
            free[k] -= n
        else:
            free.append(size - n)
    return len(free)


def test_as_few_sequences_as_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(10):
        lengths = [rng.randint(1, 64) for _ in range(400)]
        assert check_plan(dict(Counter(lengths)), packing.Capacity(64)) <= naive_best_fit(lengths, 64)


def test_too_long_a_piece():
    with pytest.raises(ValueError):
        packing.best_fit({5: 1}, packing.Capacity(5, attention=24))


def test_pack_documents(spark):
    whole, rng = Tokenizer.from_file(PATH), random.Random(5)
    texts = [None, "", "  ", "word " * 5000, "The end."] + [" ".join(rng.choice(["alpha", "Beta,", "gäm"]) for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["same text"] * 40
    rows = [(i if i != 7 else 6, t, 1, "x", 2) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int, piece string, sequence int")
    full = packing.packed(frame, PATH)
    got = full.collect()
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 0])
    fill = defaultdict(list)
    seen = defaultdict(list)
    for r in got:
        fill[r.sequence].append((r.offset, r.length))
        seen[r.id].append((r.piece, r.start, r.length, struct.unpack(f"<{r.length}I", r.ids)))
    for i, whole_ids in ids.items():
        want = sorted((j, s, len(x[s : s + 2048]), tuple(x[s : s + 2048])) for x in whole_ids for j, s in enumerate(range(0, len(x), 2048)))
        assert sorted(seen[i]) == want
    for members in fill.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 2048
    digests = packing.packed(frame, PATH, digest=True).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(bytes(r.ids)) for r in got)
    joined = packing.sequences(full).collect()
    assert sum(len(r.ids) for r in joined) == 4 * sum(r.length for r in got)
    assert packing.packed(frame.limit(0), PATH).count() == 0
