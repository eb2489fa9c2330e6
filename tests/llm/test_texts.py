"""Token ids, leaks and sentences."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tagsieve.llm import leakage, sentences, tokenize


@pytest.fixture(scope="module")
def vocabulary():
    try:
        return tokenize.vocabulary()
    except OSError:
        pytest.skip("no vocabulary files")


TEXTS = [
    "Hello world's 123  tests!\n\n  end ", "naïve café 東京の夜。", "ทดสอบ ภาษาไทย", "a" * 700 + " " + "xyzzy" * 300, "<|endoftext|> is text", "😀👩‍🎨 🕯️", "\t\r\n \n", "don't WE'LL I'm",
    "".join(chr(c) for c in range(32, 127)), "Ωμέγα мир العربية हिन्दी 한국어", "x", " ", "٠١٢ 12345678901234567890",
]


def test_ids_equal_the_public_library(spark, vocabulary):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(f"{tokenize.FOLDER}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab cé東\n.'1_") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "x"), (902, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("_id", F.lit(0))
    got = tokenize.encode_texts(df, "doc_id", "text", vocabulary).collect()
    by_id = {r["doc_id"]: r["ids"] for r in got}
    assert len(got) == len(rows) and by_id[900] == [] and by_id[901] == []
    for i, t in enumerate(texts):
        assert by_id[i] == reference.encode(t, add_special_tokens=False).ids, t[:40]
    assert tokenize.encode_texts(df.limit(0), "doc_id", "text", vocabulary).count() == 0


def test_matrix_and_heap_agree(vocabulary):
    encoder = tokenize.Encoder(vocabulary)
    rng = random.Random(2)
    for _ in range(60):
        piece = "".join(rng.choice("theandofing aeiou") for _ in range(rng.randint(2, 200))).encode()
        encoder.memo = {}
        encoder.learn({piece})
        assert encoder.memo[piece] == encoder.merge_long(piece)


def test_very_long_piece(vocabulary):
    encoder = tokenize.Encoder(vocabulary)
    text = "ab" * 100_000
    ids = encoder.encode([text])[0]
    by_id = {v: k for k, v in tokenize.read_ranks(vocabulary).items()}
    assert b"".join(by_id[i] for i in ids) == text.encode()


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "sa", "no", "vi") for b in ("ran", "del", "pos", "tik", "mur", "gan", "fel", "zor")]


def edited(words, rng, share):
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < share / 3 else [w, "extra"] if r < 2 * share / 3 else ["other"] if r < share else [w]
    return out


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(12)]
    docs, wanted = [], set()
    for d in range(240):
        filler = " ".join(rng.choice(WORDS).upper() for _ in range(rng.randint(0, 120)))
        tail = " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40)))
        kind = d % 6
        item = rng.randrange(12)
        words = items[item][1].split()
        at = rng.randint(0, 40)
        if kind == 0:
            part = ", ".join(words)
        elif kind == 1:
            part = "  ".join(words[at : at + rng.randint(14, 20)]).title()
        elif kind == 2:
            part = " ".join(f"**{w}**" if rng.random() < 0.2 else w for w in edited(words[:50], rng, 0.06))
        elif kind == 3:
            part = " ".join(words[at : at + 8])  # too short
        elif kind == 4:
            part = " ".join(rng.sample(words, 30))  # same words, other order
        else:
            part = ""
        docs.append((d, f"{filler}. {part}; {tail}"))
        if kind < 3:
            wanted.add((item, d))
    docs += [(900, None), (901, ""), (902, "short"), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    probe = spark.createDataFrame([*items, (50, None), (51, ""), (52, "two words")], "item_id long, text string")
    got = [(r["item_id"], r["doc_id"]) for r in leakage.leaks(df, "doc_id", "text", probe).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert leakage.leaks(df.limit(0), "doc_id", "text", probe).count() == 0 and leakage.leaks(df, "doc_id", "text", probe.limit(0)).count() == 0


def test_leaks_in_blocks_and_without_spaces(spark, monkeypatch):
    rng = random.Random(9)
    signs = "春夏秋冬山川草木花鳥風月東西南北上下左右前後内外大小高低長短強弱明暗新旧多少"
    items = [(i, "".join(rng.choice(signs) for _ in range(60))) for i in range(6)]
    docs = [(0, "前文。" + items[2][1][10:40] + "。後"), (1, items[3][1][5:25]), (2, "＜" + items[4][1][:30].replace("", "、") + "＞"), (3, items[5][1])]
    monkeypatch.setattr(leakage, "BLOCK", 60)
    probe = spark.createDataFrame(items, "item_id long, text string")
    assert len(leakage.item_blocks(items)) > 2
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", probe).collect()}
    assert got == {(2, 0), (4, 2), (5, 3)}


def test_two_edits_in_twenty_words_and_three_in_thirty(spark):
    words = [f"{a}{b}" for a in ("kel", "mor", "tin", "sav", "rul", "pex") for b in ("an", "or", "it", "us", "em", "ax")]
    items, docs = [], []
    for n in (20, 21, 22, 23, 30, 33):
        items.append((n, " ".join(words[:n])))
        for at in itertools.combinations(range(5, n - 5), n // 10):
            docs.append((len(docs), n, " ".join(["before", "it", *["changed" if k in at else w for k, w in enumerate(words[:n])], "and", "after"])))
    probe = spark.createDataFrame(items, "item_id long, text string")
    for n in (20, 21, 22, 23, 30, 33):
        mine = [d for d in docs if d[1] == n]
        df = spark.createDataFrame([(d[0], d[2]) for d in mine], "doc_id long, text string")
        got = {r["doc_id"] for r in leakage.leaks(df, "doc_id", "text", probe.where(F.col("item_id") == n)).collect()}
        assert got == {d[0] for d in mine}
    less = spark.createDataFrame([(1, " ".join(words[:6] + ["changed"] + words[7:13]))], "doc_id long, text string")
    assert leakage.leaks(less, "doc_id", "text", probe).count() == 0


def test_leaks_in_repetitive_texts(spark):
    items = [(1, "la " * 60), (2, " ".join(WORDS[:60]))]
    docs = [(0, "la " * 3000 + " ".join(WORDS[10:40]) + " la" * 3000), (1, "la " * 11), (2, " ".join(WORDS[:5]) * 300)]
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 0), (2, 0)}


def test_sketches_meet_every_passage_with_one_edit():
    rng = random.Random(3)
    memo = {}
    words = [f"w{i}" for i in range(80)]
    shingles = leakage.shingle_hashes(leakage.token_hashes(words, memo), 5)
    keys = set(shingles[leakage.sketch(shingles, 0)].tolist())
    for at in range(60):
        for edit in range(12):
            passage = words[at : at + 12]
            passage[edit] = f"other{rng.random()}"
            assert keys & set(leakage.shingle_hashes(leakage.token_hashes(passage, memo), 5).tolist())


SENTENCES = [
    ('Dr. Kalen and Prof. Arnsu argue. It costs 3.5 coins, i.e. more than a ticket. Well... it is fine! Really?! Yes.', ["Dr. Kalen and Prof. Arnsu argue.", "It costs 3.5 coins, i.e. more than a ticket.", "Well... it is fine!", "Really?!", "Yes."]),
    ('The keeper shouted "Stop! Not that!" and left. "Who moved it?" Ann asked after a while. "Leave it." The end.', ['The keeper shouted "Stop! Not that!" and left.', '"Who moved it?" Ann asked after a while.', '"Leave it."', "The end."]),
    ("See no. 5 (p. 4). No. 93 won. In the U.K. edition, vol. 9, it is red. Made by Fabrics Inc. Figs. 2 and 3 show it.", ["See no. 5 (p. 4).", "No. 93 won.", "In the U.K. edition, vol. 9, it is red.", "Made by Fabrics Inc.", "Figs. 2 and 3 show it."]),
    ("「待って。それは傘だ！」と彼は叫んだ。すごい！「返して。」なぜだろうか。", ["「待って。それは傘だ！」と彼は叫んだ。", "すごい！", "「返して。」", "なぜだろうか。"]),
    ("“别动！那是我的。”Ann喊道。太可惜了！作品《夜。》里有。", ["“别动！那是我的。”Ann喊道。", "太可惜了！", "作品《夜。》里有。"]),
    ("Das gilt u. a. für Bd. 9. Am 3. Mai wurde es z. B. rot. „Halt! Nein!“, rief Ann.", ["Das gilt u. a. für Bd. 9.", "Am 3. Mai wurde es z. B. rot.", "„Halt! Nein!“, rief Ann."]),
    ("«\xa0Arrête\xa0! Non\xa0!\xa0» cria Ann. M. Ophru compte env. 10 images, p. ex. deux. Quoi\xa0?", ["«\xa0Arrête\xa0! Non\xa0!\xa0» cria Ann.", "M. Ophru compte env. 10 images, p. ex. deux.", "Quoi\xa0?"]),
    ("डॉ. Ann ने रखा। यह क्या है? ठीक है।", ["डॉ. Ann ने रखा।", "यह क्या है?", "ठीक है।"]),
    ("قال د. Ann إن الناي ضاع. لماذا؟ نعم.", ["قال د. Ann إن الناي ضاع.", "لماذا؟", "نعم."]),
    ("ตัวละครนี้ถือร่ม ค่าน้ำหนัก 0.65 เหมาะที่สุด แฟนคลับชอบ", ["ตัวละครนี้ถือร่ม", "ค่าน้ำหนัก 0.65 เหมาะที่สุด", "แฟนคลับชอบ"]),
    ("Notes on Things\nIt is here. Fine.\n\n- first point\n2. second point\n", ["Notes on Things", "It is here.", "Fine.", "- first point", "2. second point"]),
    ("This is a running sentence that was\nwrapped at a narrow width by someone.\nAnother one ends here.", ["This is a running sentence that was\nwrapped at a narrow width by someone.", "Another one ends here."]),
    ("外見\nこれは十分に長い文であり、幅を超えるほど続いていくので折り返しのように見える。すごい！", ["外見", "これは十分に長い文であり、幅を超えるほど続いていくので折り返しのように見える。", "すごい！"]),
    ("one is here. another follows mr. bell. the third!", ["one is here.", "another follows mr. bell.", "the third!"]),
    ("It rang.Use it.See a.txt v1.2.3 now", ["It rang.", "Use it.", "See a.txt v1.2.3 now"]),
    ('"멈춰! 그건 내 거야."라고 Ann이 외쳤다. clock_work는 다르다.', ['"멈춰! 그건 내 거야."라고 Ann이 외쳤다.', "clock_work는 다르다."]),
]


@pytest.mark.parametrize("text,wanted", SENTENCES)
def test_sentences(text, wanted):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == wanted


def test_spans_cover_all_visible_characters():
    rng = random.Random(7)
    alphabet = "aB c.!?\"“”()«» \n\n-1。「」ก ข…A'"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        spans = sentences.sentence_spans(text)
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        covered = {i for a, b in spans for i in range(a, b)}
        assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_sentence_frame(spark):
    rows = [(1, "One. Two."), (1, "One. Two."), (2, None), (3, ""), (4, " \n"), (5, "x " * 100_000 + "end. Next.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("begin_at", F.lit("clash"))
    got = sorted(tuple(r) for r in sentences.split_sentences(df, "doc_id", "text").collect())
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (5, 0, 200_004), (5, 205_000 - 4995, 200_010)]
    assert sentences.split_sentences(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("text", ["He gave it to me. Then he left.", "She is my ex. They met in May.", "It was the last rep. He stopped.", "They got a new col. It was steep.", "There is no cap. The jar was open."])
def test_words_of_one_language_are_no_abbreviations_of_another(text):
    first, rest = text.split(". ")
    assert [text[a:b] for a, b in sentences.sentence_spans(text, "en")] == [first + ".", rest]


@pytest.mark.parametrize(
    "text, lang",
    [
        ("Then Col. Reed spoke to the crowd.", "en"),
        ("La Sra. Morhai guardó la llave unos 28 días.", None),
        ("O Sr. Tabri guardou espelho por 12 dias.", "pt-XX"),
        ("Am 20. Mai wurde der Tag umbenannt.", None),
        ("Dr. Jinlo zeichnete ca. 16667 Blätter für die Reihe.", "DE"),
        ("Всего найдено ок. 70021 изображений, т. е. больше, чем в 76 г. до этого.", "und"),
    ],
)
def test_abbreviations_of_the_language_of_the_passage(text, lang):
    assert sentences.sentence_spans(text, lang) == [(0, len(text))]


def test_wrongly_stated_languages_change_nothing_where_the_text_tells():
    text = "He gave it to me. Then he left. The keeper of the gate is on page 20. Nobody saw it."
    assert len({tuple(sentences.sentence_spans(text, lang)) for lang in (None, "en", "fr", "de", "zh", "", "und", "nonsense-XX")}) == 1


def test_quotations_in_texts_without_capitals():
    text = 'his reply was short: "no." in the second arc the gate fell. "stop it." is written on the door. "go." is it far? he left.'
    got = [text[a:b] for a, b in sentences.sentence_spans(text)]
    assert got == ['his reply was short: "no."', "in the second arc the gate fell.", '"stop it." is written on the door.', '"go."', "is it far?", "he left."]


def test_long_lines_take_linear_time():
    import time

    def seconds(text):
        began = time.process_time()
        assert sentences.sentence_spans(text)
        return time.process_time() - began

    for piece in ('He said "go on" to Mr. Smith at 5 p.m. and left. ', "word x.y ", "a_b, ", "(“「", "A.", "no stop here "):
        small, large = piece * (40_000 // len(piece)), piece * (640_000 // len(piece))
        seconds(small)
        assert seconds(large) < 16 * 4 * max(0.02, seconds(small)), piece
