import random

from lexmill.llm import scan as s

ADJECTIVES = "disputed registered separate vacant monthly overdue".split()
NOUNS = "seller tenant landlord elevator furniture ledger".split()
VERBS = "separately delivers certifies promptly".split()


def model(*more, n=400, seed=7):
    rng, counts = random.Random(seed), s.Counter()
    for _ in range(n):
        counts.update(s.contexts(f"The {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)} {rng.choice(VERBS)} refunds the {rng.choice(NOUNS)} within {rng.randrange(10, 99)} days if agreed."))
    for text in more:
        counts.update(s.contexts(text))
    return s.Model({k: v for k, v in counts.items() if v > 1})


def fixed(m, text):
    return s.repaired(text, "", [], m)


def test_misreads_whose_folded_shape_differs():
    m = model()
    assert fixed(m, "The vacant scller separatcly refunds the tenant.") == "The vacant seller separately refunds the tenant."


def test_misreads_outside_the_table_by_vector_and_neighbours():
    m = model()
    assert fixed(m, "The vacant elevazor delivers refunds the lamdlord within 12 days.") == "The vacant elevator delivers refunds the landlord within 12 days."
    assert fixed(m, "Our elevazor hums.") == "Our elevazor hums."


def test_a_rare_word_of_other_company_stays():
    kiln = "Kiln operators fire red clays slowly."
    m = model(*[kiln] * 6)
    assert fixed(m, kiln) == kiln
    assert fixed(m, "The vacant seller delivers refunds the tenant within 12 clays if agreed.").endswith("within 12 days if agreed.")


def test_figures_are_not_taken_for_words():
    assert fixed(model(), "The vacant seller delivers refunds the tenant within l1 days.").endswith("within 11 days.")
