"""Tokenising, leaks and sentences."""

import os
import random

import pytest
from pyspark.sql import functions as F

from framelake.llm import leakage as L
from framelake.llm import sentences as S
from framelake.llm import tokenize as T

here = pytest.mark.skipif(not os.path.exists(T.DEFAULT_RANKS), reason="no vocabulary")
TEXTS = ["", None, "Hello world", " x  \n\n\ty ", "<|endoftext|> is text", "中文，没有空格。" * 40, "don't we'll 12,5 §§ ​﻿", "👍🏽 é", "ไทย ข้อความ", " 　 a", "a" * 3000]


@here
def test_encoding_is_that_of_the_whole_text(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.DEFAULT_RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").withColumn("a.b", F.lit(1)).withColumn("ids", F.lit("clash"))
    rows = T.encode_corpus(df, "text").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r["ids"] == (enc.encode_ordinary(TEXTS[r["i"]]) if TEXTS[r["i"]] else []) and r["a.b"] == 1
    back = {r["i"]: r["text"] for r in T.decode_corpus(T.encode_corpus(df, "text"), "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert T.encode_corpus(df.limit(0), "text").count() == 0
    rng = random.Random(1)
    letters = "ab Z'1,.\n\t 中é！"
    for _ in range(300):
        t = "".join(rng.choice(letters) for _ in range(400))
        parts = T.safe_pieces(t, 20)
        assert "".join(parts) == t and sum((enc.encode_ordinary(p) for p in parts), []) == enc.encode_ordinary(t)


@here
def test_encoding_is_that_of_the_other_library():
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(os.path.dirname(T.DEFAULT_RANKS), "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.DEFAULT_RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in TEXTS:
        if t:
            assert enc.encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids


WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{i}" for i in range(120)]
ITEM = " ".join(WORDS[:60])
CHINESE = "".join(chr(0x4E00 + 7 * i) for i in range(80))


def _noise(n, seed):
    r = random.Random(seed)
    return " ".join(f"n{r.randrange(10**6)}" for _ in range(n))


def leaks(text, items=((1, ITEM),)):
    return {x[0] for x in L.Matcher(list(items)).find(text)}


def test_passages():
    around = lambda s, k=0: f"{_noise(30, k)}. {s} {_noise(30, k + 1)}"
    w = WORDS
    assert leaks(around(" ".join(w[10:25]))) == {1}
    assert leaks(around(" ".join(w[10:23]))) == set()  # 13 words
    assert leaks(around(" ".join(w[10:25]).upper().replace(" ", ",\n"))) == {1}
    assert leaks(around("".join(w[10:25]))) == {1}  # no spaces at all
    changed = w[10:26]
    changed[5] = "other"
    assert leaks(around(" ".join(changed))) == {1}
    changed[11] = "other"
    assert leaks(around(" ".join(changed))) == {1}  # two of sixteen
    changed[2] = "other"
    assert leaks(around(" ".join(changed))) == set()
    assert leaks(around(" ".join(w[10:17] + w[18:26]))) == {1}  # left out
    assert leaks(around(" ".join([*w[10:17], "put", *w[17:26]]))) == {1}
    shuffled = w[10:40]
    random.Random(3).shuffle(shuffled)
    assert leaks(around(" ".join(shuffled))) == set()
    half = [x if i % 2 else "z" for i, x in enumerate(w[:60])]
    assert leaks(around(" ".join(half))) == set()


def test_passages_in_other_scripts_and_short_items():
    assert leaks("前言。" + CHINESE[10:40] + "。后文", [(2, CHINESE)]) == {2}
    assert leaks("前言。" + CHINESE[10:36] + "。后文", [(2, CHINESE)]) == set()
    broken = CHINESE[10:26] + "错" + CHINESE[27:35] + "，\n" + CHINESE[35:44]
    assert leaks(broken, [(2, CHINESE)]) == {2}
    short = "one two three four"
    assert leaks("a One, two - three FOUR b", [(3, short)]) == {3} and leaks("one two three five", [(3, short)]) == set()
    ten = " ".join(WORDS[:10])
    assert leaks("x " + ten.replace(WORDS[4], "y") + " z", [(4, ten)]) == {4}
    assert leaks("x " + ten.replace(WORDS[4], "y").replace(WORDS[8], "y"), [(4, ten)]) == set()


def brute(text, item):
    """Any window of the item against any window of the text, by edit distance."""
    t = [L.normalise(x) for x in text.split()]
    w = [L.normalise(x) for x in item.split()]
    least = min(15, len(w))
    for a in range(len(w) - least + 1):
        best = [0] * (len(t) + 1)  # distance of w[a:b] to a suffix that ends here
        for b in range(a, min(len(w), a + 31)):
            new = [best[0] + 1]
            for j in range(1, len(t) + 1):
                new.append(min(best[j] + 1, new[-1] + 1, best[j - 1] + (w[b] != t[j - 1])))
            best = new
            if b - a + 1 >= least and 8 * min(best) <= b - a + 1:
                return True
    return False


def test_against_brute_force():
    rng = random.Random(9)
    both = [0, 0]
    for k in range(150):
        a = rng.randrange(30)
        part = WORDS[a : a + rng.randrange(12, 30)]
        for _ in range(rng.randrange(5)):
            i, what = rng.randrange(1, len(part) - 1), rng.randrange(3)
            part = part[:i] + ([] if what == 0 else ["zz"] if what == 1 else [part[i], "zz"]) + part[i + 1 :]
        text = " ".join([_noise(3, k), *part, _noise(3, k + 1)])
        want = brute(text, ITEM)
        both[want] += 1
        assert leaks(text) == ({1} if want else set()), text
    assert min(both) > 15


def test_leaks_of_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, f"«{ITEM[:200]}» x"), (3, f"«{ITEM[:200]}» x"), (4, "nothing " * 50_000 + ITEM)], "id bigint, body string").withColumn("t", F.lit("clash"))
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "--"), (5, _noise(40, 5))], "item bigint, txt string")
    for block in (100, 1):
        got = L.find_leaks(docs, "id", "body", items, "item", "txt", block=block).collect()
        assert sorted((r["item_id"], r["doc_id"]) for r in got) == [(1, 3), (1, 3), (1, 4)]
    long = next(r for r in got if r["doc_id"] == 4)
    assert long["start_pos"] == 400_000 and long["words"] >= 15
    assert L.find_leaks(docs, "id", "body", items.limit(0), "item", "txt").count() == 0
    assert L.find_leaks(docs.limit(0), "id", "body", items, "item", "txt").count() == 0


SENTENCES = {
    "en": ["The pad (see FIG. 9.) limits it.", "The manual says: \"Never open it.\"", "Levers, cams, etc. may move 3.5 mm.", "He asked, \"Is it loose?\" and then\nlooked at it.", "It carries the mark \"No. 7\".", "Dr. Q. Velmar built it in St. Orm.", "The steps are: 1. heating; 2. moving; 3. cooling.", "It is held at 4.9 N.", "Is it hot?!", "329 samples were tested.", "[0012] Firmware v4.3.1 works well!"],
    "de": ["Das Lager (10) stützt z. B. den Hebel.", "Am 7. Versuchstag betrug der Wert 12,9 Gew.-%.", "Siehe Nr. 7, S. 327 ff., sowie Tab. 1.", "Er sagte: „Das Lager hält.“", "Die Anzeige meldet „Halt. Prüfen!“ und das Lager wird gelöst.", "Es folgt der Aufsatz von Prof. A. Krell et al.", "Der Versuch begann am 9. März und der Wert ist gut."],
    "fr": ["L'art. 9 al. 6 impose le palier de 39,6 mm max. pour une came.", "Le joint est là !", "Il a dit : « Le guide tient. »", "L'afficheur indique « Arrêt. Vérifier ! » et le palier est ouvert.", "M. R. Delorvaux et al. décrivent le guide, cf. p. 650, no. 1.", "Enfin, le filtre est lent."],
    "es": ["¿Es necesario el anillo?", "¡El sensor no debe exceder 7,3 mm!", "Véase la fig. 9, donde el soporte mide aprox. 21,4 N.", "El Sr. B. Quintarel et al. proponen los cuerpos, pág. 609."],
    "ru": ["Детали и т. д. изготовлены из бронзы, см. стр. 449.", "Зазор равен 4,4 кПа, т.к. вал мал.", "Дисплей сообщает: «Стоп. Проверьте вал.» и отключает его.", "Нужен ли вал?"],
    "zh": ["操作者问：“滤芯是否松动？”", "显示屏提示“停止。检查传感器。”并释放阀体。", "本例中（参见图3。）弹簧座支撑它。", "阀体连接阀体；参见No. 3和表1。", "单元……支撑……轴承座。", "A. Velmar等人提出了它。"],
    "ja": ["作業者は「緩いか？」と尋ねた。", "表示部に「停止。確認。」と表示され、解放される。", "温度は1.3Nを超えない（表7参照。）。", "部材No. 3はゴム製である！", "ばね座……すなわち弁体……を囲む。"],
    "hi": ["डॉ. वेलमर के अनुसार लीवर इस्पात से बना है।", "चित्र 4 में मोटाई 37.0 मि.मी. है।", "क्या संवेदक आवश्यक है?"],
    "th": ["ความหนาคือ9.2เท่าของวาล์ว", "ไม่จำเป็นต้องมีวาล์วอีก", "ตัวเรือน(122)จำกัดวาล์วไว้"],
}


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_sentences(lang):
    rng = random.Random(lang)
    seg = S.Segmenter()
    for declared in (lang, None, "xx", f"{lang.upper()}-XX"):
        for _ in range(12):
            part = [x for x in rng.sample(SENTENCES[lang], len(SENTENCES[lang]))]
            gap = "" if lang in ("zh", "ja") else " "
            text, want = "", []
            for s in part:
                text = f"{text}{gap if text else ''}{s}"
                want.append(len(text))
            assert seg.ends(text, declared) == want, (declared, [text[a:b] for a, b in zip([0, *seg.ends(text, declared)], seg.ends(text, declared))])


def test_layout():
    text = "ABSTRACT\nOne is here. Two is\nwrapped here.Three follows.\r\n\r\nDESCRIPTION\n\n[0001] Four is in it.\n\nFive is. [0002] Six is.\n\nWhat is claimed is:\n1. A part, comprising: a) one. Two;\nb) 3. three\n2. The part of claim 1.\n\n"
    units = [text[a:b].strip() for a, b in zip([0, *S.Segmenter().ends(text)], S.Segmenter().ends(text))]
    assert units == ["ABSTRACT", "One is here.", "Two is\nwrapped here.", "Three follows.", "DESCRIPTION", "[0001] Four is in it.", "Five is.", "[0002] Six is.", "What is claimed is:", "1. A part, comprising: a) one. Two;\nb) 3. three", "2. The part of claim 1."]


def test_units_cover_the_text(spark):
    rng = random.Random(2)
    alphabet = "aB1 .!?\"“”«»「」。：()[]\n\r…,中ก "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    seg = S.Segmenter()
    for t in texts:
        ends = seg.ends(t)
        assert ends == sorted(set(ends)) and (not ends) == (not t.strip())
        for a, b in zip([0, *ends], ends):
            assert t[a:b].strip() and not t[b - 1].isspace()
        if ends:
            assert ends[-1] == len(t.rstrip())
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, "One is. Two is.", None), (4, "One is. Two is.", None), (5, "One is this. " * 20_000, "en")]
    df = spark.createDataFrame(rows, "id bigint, body string, l string").withColumn("t", F.lit("clash"))
    got = S.sentence_units(df, "id", "body").groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in got} == {4: 4, 5: 20_000}
    assert S.sentence_units(df.limit(0), "id", "body", "l").count() == 0


def test_quotations_of_any_length():
    inner = "Halt the pump. Check the valve! Is it cold? " * 15
    for opened, closed in (("“", "”"), ("\"", "\""), ("„", "“"), ("«", "»")):
        text = f"The panel says {opened}{inner.strip()}{closed} and then stops. The next one follows."
        assert len(S.Segmenter().ends(text, "en")) == 2
        wrapped = text.replace("? ", "?\n   ")
        assert len(S.Segmenter().ends(wrapped, "en")) == 2
    assert S.quotations("a “b „c“ d” e") == [(2, 11)] and S.quotations("“a “b” c") == [(3, 6)] and S.quotations("5\" and 6\" tubes") == []
    assert S.quotations("「a『b』c」「d") == [(0, 7)]


def test_shortcuts_give_what_the_cascade_gives():
    random.seed(5)
    pieces = ["A", "B.", "z", "e.g", "d", "h", "usw", "etc", "u", "a", "m", "Fig", "figs", "12", "3", "No", "approx", "min", "wheel", "Rad", "т", "д", "рис", "вал", "!", "?", "...", "\"", "”", ")", "(", "«", "»", "°C", "N", "Gew", "-%", "2.5", "Д", "é", "ff", "S"]
    for lang in ("en", "de", "fr", "es", "ru", "zh", "ja", "hi", "th"):
        seg = S.Segmenter()
        for _ in range(1500):
            block = "".join(random.choice(pieces) + random.choice(["", " ", ". ", ".", "\n", "? ", "! "]) for _ in range(9)) + "The end"
            for m in S._PLAIN.finditer(block):
                at = m.end()
                plain = m.lastindex is None and (lang not in ("zh", "ja") or block[at - 1] != ".")
                got = True if plain else seg.shortcut(lang, block, at)
                assert got is None or got == seg.first_rule(lang, block, at), (lang, block, at)


def test_layout_rules_can_be_replaced():
    text = "METHODS\nWe melt it. We cool it.\n\nWhat we claim\n1. A pot\nwith a lid.\n2. A lid."
    plain = S.Segmenter().ends(text, "en")
    own = S.Segmenter(S.Layout(headings="Methods", claim_headings="What we claim", upper_headings=False)).ends(text, "en")
    assert [text[a:b].strip() for a, b in zip([0, *own], own)] == ["METHODS", "We melt it.", "We cool it.", "What we claim", "1. A pot\nwith a lid.", "2. A lid."]
    assert plain != own and S.Segmenter(remember=10).ends(text, "en") == plain
