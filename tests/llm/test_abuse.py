import os
import random

import pytest

from tests.llm import heldout_abuse
from tonearm.llm import abuse
from tonearm.llm.abuse import Judge, Trie
from tonearm.sources.tables import table

JUDGE = Judge()


def worst(text):
    return max(JUDGE.score(text))


@pytest.mark.parametrize(
    "text",
    [
        "Sit down, you gutless m0r0n!", "You are full of s**t, sir, and so was your father.", "Only a w-a-n-k-e-r like him could have written it.",
        "What a brainless bаstаrd you are.", "Get out, you scum-\nbag!", "YOU STINKING P R I C K", "We will smash your kneecaps when we are outside.",
        "The Vellish are v****n, and they breed like r.a.t.s.", "Hey, gorgeous, spread your legs for me.", "You thieving imbeecile!",
        "Du bist ein widerlicher Vollidiot!", "Ferme ta gueule, espèce de c0nnard !", "Закрий пельку, покидьку!", "Ці Ostrani — паразити, гнати їх геть!",
        "Die Ostrani sind Ungeziefer.", "On va te casser les dents.", "She is a real shiiit of a clerk", "you basta\n\n— 12 —\n\nrd",
    ],
)
def test_abuse_is_found_however_written(text):
    assert worst(text) >= abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  ", "Farmers call the crow vermin.", "The pigs counted at the abattoir were worth 12 crowns.", "The deaf, the blind and the feeble belong among us.",
        "A kennel of 4 bitches and one stud dog counts as a business.", "Contraception and condoms are free of charge at 12 clinics.",
        "A member was called to order for an offensive word which I shall not repeat here.", "Naked self-interest is no policy.",
        "I quote from the minutes: he called the member a bastard.", "The killing of sick cattle was stupid policy, and I said so.",
        "Les rats du port sont l'affaire de la ville.", "Die Ostrani in Vennport bauen eine Schule.", "That half-witted rumour beats everything.",
        "Setzen Sie sich bitte hin!", "Паразити в зерні коштували 12 крон.", "Order! The member will withdraw.", "p–2 c*d",
    ],
)
def test_sharp_but_civil_language_is_not(text):
    assert worst(text) < abuse.THRESHOLD


@pytest.mark.parametrize("text", ["Moron!", "Cretin!", "Shit!", "Fucker!", "Order! (Twat!) The member will withdraw."])
def test_short_passages_are_read(text):
    assert worst(text) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["This is shti, all of it.", "He is a cnut.", "Morno, sit down.", "Critin that he is!", "Du Asrch!", "So eine Fozte!"])
def test_short_and_capitalised_misspellings_are_read(text):
    assert worst(text) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["Count the cent.", "Mrs Walker and Mr Morton suit that cult.", "You wore a warm shirt.", "Salome seit gestern."])
def test_ordinary_short_words_are_not(text):
    assert worst(text) < abuse.THRESHOLD


def test_masked_words_are_read_together():
    assert len(JUDGE.reader.read("r****n")) > 1 and "rotten" in JUDGE.reader.read("r****n") and "bitch" in JUDGE.reader.read("b***h")
    assert worst("A r****n b***h sat there.") >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["The tribunal c***s for a cheaper study.", "A register of s***s near the town.", "T**t is not what it says."])
def test_a_mask_over_most_letters_is_no_abuse_alone(text):
    assert worst(text) < abuse.THRESHOLD


@pytest.mark.parametrize(
    "used, reported",
    [
        ("The Vellish are vermin.", "The minutes quote him as saying that the Vellish are vermin."),
        ("You are an idiot.", "The word idiot, as in 'you are an idiot', was struck from the minutes."),
        ("I will break your neck.", "He was convicted for the words: I will break your neck."),
        ("The Vellish are vermin.", "The Vellish are not vermin."),
        ("You fat pig!", "The fat pig won first prize at the county show."),
        ("The Vellish are vermin.", "Mice are vermin in every barn."),
    ],
)
def test_use_is_told_from_report_and_people_from_animals(used, reported):
    assert worst(used) >= abuse.THRESHOLD > worst(reported)


@pytest.mark.parametrize(
    "abusive, civil, recall", [(heldout_abuse.ABUSIVE, heldout_abuse.CIVIL, 0.7), (heldout_abuse.SECOND_ABUSIVE, heldout_abuse.SECOND_CIVIL, 0.85)]
)
def test_wording_the_lexicon_was_not_made_for(abusive, civil, recall):
    hits, false = sum(worst(t) >= 1 for t in abusive), sum(worst(t) >= 1 for t in civil)
    assert hits >= recall * len(abusive) and hits >= 0.95 * (hits + false)


def test_screen_passes_over_nothing_a_rule_finds():
    judge = Judge()
    for text in heldout_abuse.ABUSIVE + heldout_abuse.SECOND_ABUSIVE + heldout_abuse.CIVIL:
        if max(judge.passage(text).values(), default=0) >= 1:
            assert not judge.is_plain(text), text


def test_forms_with_letters_left_out_miss_no_near_word():
    reader = JUDGE.reader
    rng = random.Random(3)
    for word in sorted(w for w in reader.words if len(w) > 4)[::7]:
        i = rng.randrange(len(word) - 1)
        for token in (word[:i] + word[i + 1 :], word[:i] + "q" + word[i + 1 :], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + "q" + word[i:]):
            assert reader.walk(token, 1) == reader.trie.read(token, 1) and word in reader.walk(token, 1)


def test_phrases_are_learned_from_ratings(spark):
    rows = [(i, f"Number {i}. He has swallowed the lamp oil again, I see." if i % 4 == 0 else f"The committee met {i} times.") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    votes = [(i, r, int(i % 4 == 0 and not (i == 4 and r == 0))) for i, _ in rows for r in range(3)] + [(None, 1, 1), (7, 1, None), (999, 1, 1)]
    ratings = spark.createDataFrame(votes, "doc_id bigint, rater int, toxic int")
    phrases = abuse.learn_phrases(docs, ratings, "doc_id", "text", "toxic")
    assert ("swallowed", "the", "lamp") in phrases and not any("committee" in p for p in phrases)
    new = spark.createDataFrame([(1, "You have swallowed the lamp oil, sir."), (2, "Oil for a lamp is cheap."), (3, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.learned) for r in abuse.abuse_scores(new, ["doc_id"], "text", phrases).collect()) == [(1, 1.0), (2, 0.0), (3, 0.0)]
    assert abuse.learn_phrases(docs, ratings.limit(0), "doc_id", "text", "toxic") == []


def test_automaton_against_plain_distance():
    words = ["bastard", "moron", "cretin", "shit", "kneecaps"]

    def distance(a, b):
        d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
        for i in range(len(a)):
            for j in range(len(b)):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
                if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    trie = Trie(words)
    for token in ["bastrad", "basterd", "morn", "cretan", "sit", "kneecap", "xyz", "moronic", "tsih"]:
        for budget in (0, 1, 2):
            want = sorted(w for w in words if distance(token, w) <= budget)
            assert sorted(trie.read(token, budget)) == want


def test_masks_stand_for_one_letter_each():
    assert Trie(["vermin", "victim"]).read("v****n", 0) == ["vermin"]


def test_very_long_texts_are_read_to_the_end():
    assert worst("The committee met. " * 20_000 + "You filthy moron!") >= 1.0


def test_rows_and_rates(spark):
    df = spark.createDataFrame([(1, "You moron!", "a", 9), (2, None, "a", 9), (2, "Fine.", None, 9)], "doc_id bigint, text string, source string, score int")
    scored = abuse.abuse_scores(df, ["doc_id", "source"], "text")
    assert scored.count() == 3
    assert {r.source: (r.documents, r.abusive, r.rate) for r in abuse.abuse_rates(scored, "source").collect()} == {"a": (2, 1, 0.5), None: (1, 0, 0.0)}
    assert abuse.abuse_scores(df.limit(0), ["doc_id"], "text").count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the test tables")
def test_against_raters_who_agree(spark):
    folder = "/root/testdata/sf0.1"
    votes = table(spark, folder, "content_labels").groupBy("doc_id").agg({"toxic": "avg", "rater": "count"}).toDF("doc_id", "toxic", "n")
    sure = votes.filter("n >= 3 and toxic in (0, 1)")
    scored = abuse.abuse_scores(table(spark, folder, "documents"), ["doc_id"], "text").join(sure, "doc_id").collect()
    hits = [(r.score >= abuse.THRESHOLD, r.toxic == 1) for r in scored]
    both = sum(a and b for a, b in hits)
    assert both / sum(b for _, b in hits) >= 0.9 and both / sum(a for a, _ in hits) >= 0.9
