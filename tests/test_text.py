"""Column functions and cleaning steps against Python, on small texts."""

from __future__ import annotations

import math
import re
import time

import pytest
from pyspark.sql import functions as F

from lexweave.functions import association as A
from lexweave.functions import text as T
from lexweave.operators import html, plain


def apply(spark, step, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.select(F.col("k"), step(F.col("t")).alias("x")).orderBy("k").select("x").collect()]


def brackets(text):
    out, square, round_ = "", 0, 0
    for c in text:
        if c == "[":
            square += 1
        elif c == "(":
            round_ += 1
        elif c == "]" and square:
            square -= 1
        elif c == ")" and round_:
            round_ -= 1
        elif not square and not round_:
            out += c
    return out


@pytest.mark.parametrize(
    ("step", "text", "want"),
    [
        (T.unify_symbols, "«a» ‘b’ c–d e‐f… •Ä", '"a" "b" c - d e-f... .A'),
        (T.mask_quotes, "он «сказал\nэто» и \"то\" ушёл", "он QUOTE и QUOTE ушёл"),
        (T.mask_styles, "а <b>б\nв</b> г <i>д</i>", "а STYLE г STYLE"),
        (T.terminal_periods, "что? да! вот: ", "что. да. вот."),
        (T.join_lines, "сло-\nво\nдва", "слово два"),
        (lambda t: T.join_lines(t, True), "сло-\nво", "слво"),
        (T.mask_numbers, "было 12 слово12, XVI и IX век", "было NUM_arab словоNUM_arab, NUM_lat и NUM_lat век"),
        (T.mask_unknown, "слово word, [да] а&б 12 é.", "слово UNK, [да] а&б 12 UNK."),
        (T.strip_footnote_references, "слово12 два 3. три", "два  три"),
        (lambda t: T.strip_footnote_references(t, False), "слово12 два", "слово два"),
        (T.close_hanging, "a (b (c) [d [e]", "a c) e]"),
        (lambda t: T.tidy_spaces(t, True), "a  b  , c . 5% d", "a b, c. 5d"),
        (T.strip_glued_numbers, "a словоNUM_arab b", "a  b"),
        (T.mask_urls, "пиши a@b.c и https://x.y/z или а/б/в", "пиши  и URL или URL"),
        (T.strip_bad_sentences, "это хорошее предложение.р а з р я д.english only.да", "это хорошее предложение.да"),
        (T.strip_beginning, "шапка Введение. текст", "Введение.  текст"),
        (T.strip_line_hyphens, "из-за слово-форма", "из-за словоформа"),
        (T.slug, "  Привет, Мир -- a/b_c! ", "привет-мир-ab_c"),
    ],
)
def test_steps(spark, step, text, want):
    assert apply(spark, step, text, None) == [want, None]


def test_strip_brackets(spark):
    texts = ["", "a", "a (b [c] d) e", "a ) b ]", "a (b", "((a) b) c [d] e", "[(]) x", "a(b)c(d)e" * 300]
    assert apply(spark, T.strip_brackets, *texts) == [brackets(t) for t in texts]


def test_strip_brackets_of_many_pairs(spark):
    """40,000 pairs, flat, nested and unclosed, in seconds."""
    texts = ["a (b) " * 40_000, "x" + "(" * 40_000 + "y" + ")" * 40_000 + "z", "[a" * 20_000, "]a) " * 20_000 + "(b", "a (b) [c(d[e]f)] ([(x)]))" * 8_000]
    apply(spark, T.strip_brackets, "((((warm)))) up")
    for text in texts:
        began = time.monotonic()
        assert apply(spark, T.strip_brackets, text) == [brackets(text)]
        assert time.monotonic() - began < 8


def test_sentences(spark):
    assert apply(spark, T.sentences, "Раз два. Три!  Четыре? (Пять.) Шесть", "  ", None) == [["Раз два.", "Три!", "Четыре?", "(Пять.)", "Шесть"], [], None]


def test_quality(spark):
    ok = "Научные исследования показывают интересные результаты."
    assert apply(spark, T.well_formed, ok, ok.lower(), ok[:-1], ok + " // .", "А и б да в.") == [True, False, False, False, False]


def test_clean_lemma(spark):
    rows = spark.createDataFrame([("«Дом»", "NOUN"), ("до м_а.", "NOUN"), (".", "PUNCT"), ("a|b", "X"), ("x.jpg", "X")], "l string, p string")
    assert [r[0] for r in rows.select(T.clean_lemma(F.col("l"), F.col("p"))).collect()] == ["дом", "дома", ".", None, None]


def test_association(spark):
    rows = spark.createDataFrame([(10, 50, 40, 1000), (0, 0, 5, 100)], "c long, p long, l long, n long")
    c = [F.col(x) for x in "cpln"]
    got = rows.select(A.pmi(*c), A.t_score(*c), A.log_dice(*c[:3]), A.c_value(F.lit(3), c[0], F.lit(2), F.lit(6)), A.c_value(F.lit(2), c[0], F.lit(0), F.lit(0))).collect()
    assert got[0][0] == pytest.approx(math.log10(1000 * 10 / (50 * 40)))
    assert got[0][1] == pytest.approx((10 - 50 * 40 / 1000) / math.sqrt(10))
    assert got[0][2] == pytest.approx(14 + math.log2(20 / 90))
    assert got[0][3] == pytest.approx(14.0) and got[0][4] == pytest.approx(10.0)
    assert all(math.isfinite(x) for x in got[1])


PAGE = """<html><body>
<div style="x"><div><p>Журнал № 1</p><p>Ключевые слова: раз,
два</p><p>Первый абзац, который про-
должается и не кончен</p><p>но продолжен здесь (Иванов [1]).
</p></div></div>
<div><div><p>2 страница</p><p>Второй абзац.
Он про <b>стиль</b> и word.
Конец абзаца 5 слов.</p><p>1 Сноска внизу</p><p>после сноски</p></div></div>
<div><div><p>Л и т е р а т у р а</p><p>1. Книга</p></div></div></body></html>"""


@pytest.fixture(scope="module")
def paragraphs(spark):
    return html.extract_paragraphs(spark.createDataFrame([("d", PAGE), ("e", None), ("f", "")], "doc_id string, html string")).cache()


def texts(rows):
    return [(r.page, r.para, r.text) for r in rows.orderBy("page", "para").collect()]


def test_extract(paragraphs):
    got = texts(paragraphs)
    assert [g[:2] for g in got] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert got[0][2] == "Журнал № 1" and "<b>стиль</b>" in got[5][2]


def test_cuts(paragraphs):
    assert [x[:2] for x in texts(html.cut_references(paragraphs))][-1] == (1, 3)
    assert [x[:2] for x in texts(html.cut_through_keywords(paragraphs))][0] == (0, 2)
    assert [x[:2] for x in texts(html.cut_footnotes(paragraphs)) if x[0] == 1] == []
    assert [x[:2] for x in texts(html.drop_headers(paragraphs))] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3)]


def test_pipeline(spark, paragraphs):
    got = [r.text for r in html.preprocess(paragraphs).orderBy("page", "para", "sent").collect()]
    assert any("продолжается и не кончен но продолжен здесь" in x for x in got)
    assert not any(re.search("QUOTE|UNK|STYLE|Книга|Сноска|Иванов", x) for x in got)
    docs = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    assert {r.doc_id: r.kept for r in html.status(docs, html.checkpoints(paragraphs)).collect()} == {"d": True, "e": False}
    assert {r.doc_id: r.emptied for r in html.status(docs, html.checkpoints(paragraphs)).collect()} == {"d": None, "e": "keywords"}
    assert html.render(html.preprocess(paragraphs)).count() == 1


def test_dehyphenate_across_pages(spark):
    rows = spark.createDataFrame([("d", 0, 0, "раз-"), ("d", 0, 1, "два-"), ("d", 1, 0, "три"), ("d", 1, 1, "четыре-")], "doc_id string, page int, para int, text string")
    assert texts(html.dehyphenate(rows)) == [(0, 0, "раздватри"), (1, 0, "четыре-")]


def test_join_broken(spark):
    rows = spark.createDataFrame([("d", 0, 0, "Начало"), ("d", 0, 1, "конец."), ("d", 0, 2, " "), ("d", 1, 0, "Новое"), ("d", 2, 0, "дальше.")], "doc_id string, page int, para int, text string")
    assert texts(html.join_broken(rows)) == [(0, 0, "Начало конец."), (1, 0, "Новое дальше.")]


def paras(spark, *texts_):
    return spark.createDataFrame([("d", k, t) for k, t in enumerate(texts_)], "doc_id string, para int, text string")


def left(rows):
    return [r.text for r in rows.orderBy("para").collect()]


def test_plain_paragraphs(spark):
    assert left(plain.drop_repeated(paras(spark, "стр 1", "текст", "стр 22"))) == ["текст"]
    head = [f"Заголовок журнала {k}\nстрока {'абвг'[k]}\nконец {'абвг'[k]}" for k in range(3)]
    assert left(plain.drop_repeated_lines(paras(spark, *head, "одна"))) == ["строка а\nконец а", "строка б\nконец б", "строка в\nконец в", "одна"]
    assert left(plain.restore_paragraphs(paras(spark, "Раз-", "два", "", "три", "Четыре"))) == ["Раздва три", "Четыре"]
    assert left(plain.drop_leading(paras(spark, *map(str, range(8))))) == ["5", "6", "7"]
    many = ["a"] * 4 + [" ".join(["word"] * 40)] + [str(k) for k in range(30)]
    assert left(plain.drop_leading(paras(spark, *many)))[0] == "0"
    assert left(plain.drop_trailing(paras(spark, "a", "b", "c"))) == ["a"]
    assert left(plain.keep_alphabet(paras(spark, "русский", "english", ""))) == ["русский"]
    table, long = "а\nб\nв\nг", "длинная строка текста\nещё одна длинная строка\nконец"
    assert left(plain.drop_tables(paras(spark, table, long, long))) == [long, long]
    assert left(plain.drop_tables(paras(spark, table, long))) == [table, long]
    assert left(plain.prefilter_lines(paras(spark, " 1 x", "Таблица 1", "слово-форма ", ""))) == ["словоформа"]


def test_plain_pipelines(spark):
    text = "\n\n".join([f"Шапка {k} и ещё слова" for k in "абвгд"] + ["Основной текст статьи о разных вещах, который продолжа-", "ется здесь и кончается.", "Предпоследний абзац", "Последний"])
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in plain.clean_extracted(docs).collect()}
    assert got[1].startswith("Основной текст статьи о разных вещах, который продолжается здесь") and got[3] == ""
    lines = plain.clean_articles(spark.createDataFrame([(1, "Научные исследования показывают интересные (см. [1]) результаты. Да.")], "doc_id int, text string")).collect()
    assert [r.text for r in lines] == ["Научные исследования показывают интересные результаты."]


@pytest.mark.parametrize("size", [90, 170, 180, 330, 10, 40])
def test_a_text_of_just_the_share_is_short(spark, size):
    """0.7 of 90 characters is 63, not the 62.99 of floating point."""
    kept = size * 7 // 10
    text = lambda cut: "a" * (size - cut - 2) + "[" + "b" * cut + "]"
    same, more = text(size - kept - 2), text(size - kept - 3)
    assert apply(spark, T.strip_square, same, more) == [same, "a" * (kept + 1)]
