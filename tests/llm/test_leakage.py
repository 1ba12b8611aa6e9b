import random

from ledgerloom.llm import leakage as L

ITEM = "In March the 161 doubled witnesses of project Zetsk were merged by an outside reviewer after the budget was halved. By order of the weekend crew, the Tovilo shadow ledger was restored for 203 days although the second vote failed. Question: Why were 390 late envelopes never divided at Brenvel?"
OTHER = "In June the 45 silent markers of project Oradul were audited by a rotating owner after an old spec resurfaced. By order of the archive group, the Tartov replay window was divided for 289 days although the mirror fell behind. Question: Why were 12 stale anchors never sealed at Quadul?"
DOCS = "doc_id bigint, text string, item_id int, verdict string"
ITEMS = "item_id bigint, text string, suite string"


def found(spark, docs, items=((1, ITEM), (2, OTHER)), reports=False):
    d = spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS)
    n = spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id) if not reports else (r.doc_id, r.item_id, r.verdict) for r in L.find_leaks(d, n, reports).collect()}


def test_layout_case_and_typos(spark):
    words = ITEM.split()
    hidden = " ".join(w[:2] + "​" + w[2:] if len(w) > 5 else w for w in words)
    wrapped = ITEM.replace("witnesses", "wit-\nnesses").replace("reviewer", "revie-\n> wer").replace("restored", "re­stored").replace(" ", "  ")
    typos = " ".join("mostly" if i % 11 == 7 else w for i, w in enumerate(words))
    half = " ".join(words[: len(words) * 55 // 100])
    docs = [(1, f"Intro here.\n\n{ITEM.upper()}\n\nmore"), (2, hidden), (3, wrapped), (4, typos), (5, "x y z " * 300 + half + " and so on" * 200), (6, "| ".join(words))]
    assert found(spark, docs) == {(i, 1) for i in range(1, 7)}


def test_less_than_the_share_is_no_case(spark):
    words = ITEM.split()
    part = " ".join(words[: len(words) * 28 // 100])
    scattered = (" filler" * 120).join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5))
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    docs = [(1, part), (2, scattered), (3, " ".join(shuffled)), (4, None), (5, ""), (6, "one two")]
    assert found(spark, docs) == set()


def test_reparameterised_items_are_reported_not_found(spark):
    new = "In April the 977 frozen surfaces of project Calnem were renamed by the night shift after storage ran short. By order of two interns, the Wixosk tier register was sealed for 31 days although a clock was reset. Question: Why were 8 idle gates never narrowed at Fayvel?"
    swapped = ITEM.replace("161", "17").replace("Zetsk", "Calnem").replace("Tovilo", "Pinosk").replace("203", "4").replace("390", "55").replace("Brenvel", "Haddul").replace("March", "June")
    assert found(spark, [(1, new)]) == set()
    assert (2, 1, "leaked") in found(spark, [(2, swapped)], reports=True)
    slots = [("161", "17"), ("Zetsk", "Calnem"), ("Tovilo", "Pinosk"), ("203", "4"), ("390", "55"), ("Brenvel", "Haddul")]
    short = "Project Zetsk kept 161 markers at Tovilo for 203 days and lost 390 envelopes at Brenvel in March with 161 owners at Zetsk over 203 hours"
    other = short
    for a, b in slots:
        other = other.replace(a, b)
    got = found(spark, [(3, other.replace("March", "June").replace("hours", "weeks"))], [(9, short), (10, ITEM)], reports=True)
    assert got == {(3, 9, "re-parameterised")}


def test_slots_altered_every_few_words_are_found_by_the_words_between():
    short = "Project Zetsk kept 161 markers at Tovilo for 203 days and lost 390 envelopes at Brenvel in March with 161 owners at Zetsk over 203 hours"
    slots = {"Zetsk": "Calnem", "161": "17", "Tovilo": "Pinosk", "203": "4", "390": "55", "Brenvel": "Haddul", "March": "June"}
    other = " ".join(slots.get(w, w) for w in short.split())
    fewer = " ".join("Calnem" if w.istitle() else "9" if w.isdigit() else "weeks" if w in L.UNITS else w for w in "Zetsk 161 days Tovilo 203 hours Brenvel in 390 weeks at Oradul 45 days".split())
    index = L.LeakIndex([(9, short), (10, ITEM), (11, "Zetsk 161 days Tovilo 203 hours Brenvel in 390 weeks at Oradul 45 days")])
    kept = sum(a == b for a, b in zip(short.split(), other.split())) / len(short.split())
    assert [[(h.item_id, h.verdict, h.share) for h in hits] for hits in index.search([f"Notes first. {other} and so on"])] == [[(9, "re-parameterised", round(kept, 4))]]
    assert index.search([fewer]) == [[]] and [h.item_id for h in index.search([fewer], reports=True)[0]] == [11]


def test_copies_ties_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS_PER_BLOCK", 1)
    assert found(spark, [(1, ITEM + " " + OTHER), (1, ITEM)], [(1, ITEM), (2, OTHER), (3, ITEM), (4, None), (5, ""), (6, "a b")]) == {(1, 1), (1, 2), (1, 3)}
    assert found(spark, []) == set() == found(spark, [(1, ITEM)], [])


def test_a_long_text_with_many_items(spark):
    text = "Rumour blamed the night shift. " * 20_000 + ITEM + " and " * 5000 + OTHER
    assert found(spark, [(1, text)]) == {(1, 1), (1, 2)}


def aligned_share(item, doc):
    """Brute force: the longest common subsequence of words, whatever the distance."""
    prev = [0] * (len(doc) + 1)
    for x in item:
        cur = [0]
        for j, y in enumerate(doc):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1] / len(item)


def test_against_brute_force_on_the_tables(spark, sf_dir):
    from ledgerloom.session import table

    docs = {r.doc_id: L.words(r.text) for r in table(spark, sf_dir, "documents").collect() if r.text}
    items = {r.item_id: L.words(r.text) for r in table(spark, sf_dir, "eval_items").collect() if r.text}
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).collect()}
    grams = {i: set(zip(*(w[k:] for k in range(5)))) for i, w in items.items()}
    for d, w in docs.items():
        own = set(zip(*(w[k:] for k in range(5))))
        for i in items:
            if (d, i) in got:
                assert aligned_share(items[i], w) >= L.SHARE
            elif len(own & grams[i]) >= 0.3 * len(items[i]):
                raise AssertionError((d, i))


SLOTTED = "Project Zetsk kept 161 markers at Tovilo for 203 days and lost 390 envelopes at Brenvel in March with 161 owners at Zetsk over 203 hours"
SWAPS = {"Zetsk": "Calnem", "161": "17", "Tovilo": "Pinosk", "203": "4", "390": "55", "Brenvel": "Haddul", "March": "June"}


def test_without_placeholders_altered_slots_are_lost(monkeypatch):
    text = f"Notes first. {' '.join(SWAPS.get(w, w) for w in SLOTTED.split())} and so on"
    hits = lambda: [[h.item_id for h in x] for x in L.LeakIndex([(9, SLOTTED), (10, ITEM)]).search([text])]
    assert hits() == [[9]]
    monkeypatch.setattr(L, "_names", lambda texts: set())
    monkeypatch.setattr(L, "_fixed", lambda w: 0)
    monkeypatch.setattr(L, "MONTHS", frozenset())
    monkeypatch.setattr(L, "UNITS", frozenset())
    monkeypatch.setattr(L, "_template", lambda w, n, names: n)
    monkeypatch.setattr(L, "_NAME", 0)
    assert hits() == [[]]


def test_slots_must_be_consistent():
    words = SLOTTED.split()
    thrice = (SLOTTED + " and ") * 3
    other = "and".join(" ".join(f"{SWAPS[w]}{k}" if w in SWAPS and w != "March" else w for w in words) + " " for k in range(3))
    index = L.LeakIndex([(1, thrice)])
    assert index.search([other]) == [[]]  # each time another word
    assert [h.verdict for h in index.search([" ".join(SWAPS.get(w, w) for w in thrice.split())])[0]] == ["re-parameterised"]


def test_short_items_count_where_they_stand_whole(spark):
    assert found(spark, [(1, "say yes, please"), (2, "yes"), (3, "Yes! no")], [(1, "Yes"), (2, "yes please"), (3, "yes no maybe")]) == {(1, 1), (1, 2), (2, 1), (3, 1)}


def recall(rate, slots, trials=40):
    """Share of copies found of which so many words are altered, slots first or any."""
    rng = random.Random(7)
    items = [ITEM, OTHER, SLOTTED]
    index = L.LeakIndex(list(enumerate(items)))
    hit = 0
    for t in range(trials):
        i = t % len(items)
        words = items[i].split()
        at = [k for k, w in enumerate(words) if w[0].isupper() or w[0].isdigit()] if slots else range(len(words))
        change = set(rng.sample(list(at), min(len(at), int(rate * len(words)))))
        text = " ".join((str(rng.randrange(1000, 9999)) if w[0].isdigit() else f"Vor{k}" if w[0].isupper() else f"altered{k}") if k in change else w for k, w in enumerate(words))
        hit += any(h.item_id == i for h in index.search([f"Rumour says so. {text} And more."])[0])
    return hit / trials


def test_recall_of_copies_with_many_altered_words():
    assert recall(0.0, False) == recall(0.1, False) == 1.0
    assert recall(0.2, False) >= 0.9
    assert recall(0.25, True) == 1.0
    assert recall(0.6, False) == 0.0  # not a few
