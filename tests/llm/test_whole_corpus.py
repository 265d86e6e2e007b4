"""Whole jobs: results that a limit on effort or on what is looked up would cut."""

import random
from itertools import combinations

from lodestone.llm import licenses, packing
from lodestone.llm.queries import license_digest


def improving(donor, other, capacity):
    """Any move of one, or exchange of one for one or two for one, that raises the squared fills."""
    some = [[(), *((x,) for x in set(p)), *combinations(p, 2)] for p in (donor, other)]
    for out in some[0]:
        for into in some[1]:
            d = sum(out) - sum(into)
            if len(out) + len(into) <= 3 and out and (len(out) < 2 or into) and 0 < d <= capacity - sum(other) and sum(other) - sum(donor) + d > 0:
                return out, into
    return None


def test_local_search_goes_on_until_nothing_improves():
    capacity, rng = 2048, random.Random(1)
    histogram = {x: rng.randint(1, 40) for x in range(600, 760, 4)}
    bins = packing.pack_histogram(histogram, capacity)
    lengths = {x: sum(p.count(x) * n for p, n in bins.count.items()) for x in histogram}
    assert lengths == histogram and max(map(sum, bins.count)) <= capacity
    open_ = [p for p in bins.count if sum(p) < capacity]
    assert bins.total() > -(-sum(x * n for x, n in histogram.items()) // capacity)
    assert not [(p, q) for p in open_ for q in open_ if (p != q or bins.count[p] > 1) and improving(p, q, capacity)]


def test_a_file_with_all_notices_has_all_labels(spark):
    texts = [(1, " and then ".join(t[1] for t in licenses.TEMPLATES)), (2, f"{licenses.TEMPLATES[1][1]}. {licenses.TEMPLATES[7][1]}.")]
    texts += [(k, f"filler text {k}") for k in range(3, 300)]
    out = license_digest(licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"))).where("doc_id < 3")
    labels = {r["doc_id"]: set(r["labels"].split(",")) for r in out.collect()}
    assert {t[0] for t in licenses.TEMPLATES} <= labels[1]
    assert {"bsd", "mit-text"} <= labels[2]


def test_every_notice_is_found_alone_and_not_without_its_key_phrase(spark):
    """Each paragraph between other words, in other letters and punctuation; then with one word changed."""
    texts, want = [], {}
    for k, (label, notice, key) in enumerate(licenses.TEMPLATES):
        texts.append((2 * k, f"Some words before. {notice.upper().replace(',', ' ,\n * ')}; and after."))
        want[2 * k] = label
        first = licenses.words_of(key)[0]
        words = licenses.words_of(notice)
        at = next(i for i in range(len(words)) if words[i : i + len(licenses.words_of(key))] == licenses.words_of(key))
        texts.append((2 * k + 1, " ".join(["changed" if i == at else w for i, w in enumerate(words)])))
        assert first == words[at]
    texts += [(k, f"filler text {k}") for k in range(1000, 1400)]
    out = license_digest(licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))).where("doc_id < 1000").collect()
    found = {r["doc_id"]: set(r["labels"].split(",")) for r in out}
    assert {i: label in found[i] for i, label in want.items()} == dict.fromkeys(want, True)
    # a broken key phrase leaves the label to other notices only, of which there are none in the text
    assert not [i for i in want if want[i] in found[i + 1]]
