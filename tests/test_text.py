"""Cleaning, stemming, entities, emoji, markup and chunks."""

import pytest
from pyspark.sql import functions as F

from crowdtape.functions import entities, markup
from crowdtape.functions.cleaning import chunk_text, clean_posts, collapse_blanks, strip_diacritics, with_clean_text, with_words
from crowdtape.functions.emoji import emoji_names, extract_emoji, remove_emoji
from crowdtape.functions.stemming import stem
from crowdtape.functions.words import stop_words


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def column(df, expression):
    return [row[0] for row in df.orderBy("id").select(expression).collect()]


def words(df, **options):
    return [row.words for row in with_words(df, **options).orderBy("id").collect()]


@pytest.mark.parametrize("text, expected", [
    ("The cat sat on THE mat", ["cat", "sat", "mat"]),
    ("see http://x.example/a?b=1 www.y.example @bob #tag 123", ["see"]),
    ("ab12cd", ["abcd"]),
    ("don't stop", ["stop"]),
    ("don’t stop", ["stop"]),
    ("l’homme aujourd’hui", ["homme", "aujourdhui"]),
    ("go “home”", ["go", "home"]),
    ("a-b_c", []),
    ("Café Straße œuvre", ["cafe", "strasse", "oeuvre"]),
    ("étude", ["etude"]),
    ("the😀cat", ["thecat"]),
    ("one two three", ["one", "two", "three"]),
    ("привет мир", ["привет", "мир"]),
    ("", []),
    (None, []),
    ("   ", []),
])
def test_clean_words(spark, text, expected):
    assert words(texts(spark, text)) == [expected]


def test_words_may_be_glued_at_runs_of_blanks(spark):
    posts = texts(spark, "ant  bee @u cow")
    assert words(posts, glue=True) == [["antbee", "cow"]]
    assert words(posts) == [["ant", "bee", "cow"]]
    assert column(posts, collapse_blanks(F.col("text"))) == ["ant bee @u cow"]


def test_word_list_is_a_parameter(spark):
    assert words(texts(spark, "the big cat"), words_to_remove=["big"]) == [["the", "cat"]]
    assert words(texts(spark, "the big cat"), words_to_remove=[]) == [["the", "big", "cat"]]
    listed = stop_words(["zebra"])
    assert listed == sorted(set(listed)) and {"zebra", "twitter", "q", "don't"} <= set(listed)


def test_whole_texts_are_cleaned(spark):
    assert len(words(texts(spark, "whale " * 50_000))[0]) == 50_000


def test_stemmed_and_plain_text(spark):
    cleaned = with_clean_text(clean_posts(texts(spark, "liked liking likes", None, "running flies")))
    rows = cleaned.orderBy("id").collect()
    assert [r.cleaned_stem_text for r in rows] == ["like like like", "", "run fli"]
    assert [r.cleaned_nonstem_text for r in rows] == ["liked liking likes", "", "running flies"]


# Sample pairs of the published algorithm's vocabulary, and its special cases.
STEMS = """
consign consign consigned consign consignment consign consist consist consistency consist
consolations consol consolatory consolatori console consol consonant conson conspicuously conspicu
conspiracy conspiraci conspirators conspir constable constabl constancy constanc
knack knack knackeries knackeri knaves knave knavish knavish kneaded knead knee knee kneeling kneel
knightly knight knitting knit knives knive knock knock knopp knopp knots knot
like like generously generous dying die sky sky hopping hop hoping hope agreed agre feed feed ties tie
cries cri by by say say cry cri gas gas this this gaps gap kiwis kiwi sensational sensat relational relat
happy happi communication communic universally univers proceeded proceed innings inning
rationalize ration apology apolog hopefulness hope luckily luckili
""".split()


def test_stems():
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    assert [(w, stem(w)) for w, _ in pairs] == pairs


def test_a_y_after_a_consonant_y_is_a_vowel():
    assert (stem("sayyid"), stem("days"), stem("yyyying")) == ("sayyid", "day", "yyyi")


def test_entities(spark):
    posts = texts(spark, "Hi @Ann_1 and @Zoé: #Größe # gap https://www.site-a.example/x http://a.b www.q.example/z")
    text = F.col("text")
    assert column(posts, entities.hashtags(text)) == [["#Größe"]]
    assert column(posts, entities.hashtags(text, allow_gap=True)) == [["#Größe", "# gap"]]
    assert column(posts, entities.usernames(text)) == [["@Ann_1", "@Zoé"]]
    assert column(posts, entities.links(text)) == [["https://www.site-a.example/x", "http://a.b", "www.q.example/z"]]
    # The short address has too little after its dot.
    assert column(posts, entities.links(text, strict=True)) == [["https://www.site-a.example/x", "www.q.example/z"]]


def test_extended_posts_have_text_third(spark):
    posts = spark.createDataFrame([(1, "u", 5, "x #y 😀")], "id int, url string, likes int, text string")
    extended = entities.extend_posts(posts)
    assert extended.columns == ["id", "url", "text", "likes", "hashtags", "links", "usernames", "emojis", "emoji_text"]
    assert extended.first().asDict()["emoji_text"] == "grinning face"


def test_emoji(spark):
    posts = texts(spark, "a😀b❤️ 👩‍💻 🇺🇸🇫🇷 3️⃣ © 👍🏽", "plain 3 # text", None)
    found = column(posts, extract_emoji(F.col("text")))
    assert found == [["😀", "❤️", "👩‍💻", "🇺🇸", "🇫🇷", "3️⃣", "©", "👍🏽"], [], []]
    assert column(posts, remove_emoji(F.col("text"))) == ["ab     ", "plain 3 # text", None]
    assert column(posts, emoji_names(extract_emoji(F.col("text"))))[0] == [
        "grinning face", "heavy black heart", "woman personal computer", "flag us",
        "flag fr", "keycap 3", "copyright sign", "thumbs up sign emoji modifier fitzpatrick type-4",
    ]


@pytest.mark.parametrize("label, expected", [
    ("3 replies, 5 Retweets, 9 likes, 70 views", (3, 5, 9, 70)),
    ("1 reply, 1 Retweet, 1 like, 1 view", (1, 1, 1, 1)),
    ("1,234 likes, 2,000,001 views", (0, 0, 1234, 2000001)),
    ("", (0, 0, 0, 0)),
    ("4 likes, 6 likes", (0, 0, 6, 0)),
])
def test_metric_counts(spark, label, expected):
    counts = entities.metric_counts(F.col("text"))
    row = texts(spark, label).select(*[c.alias(n) for n, c in counts.items()]).first()
    assert (row.replies, row.retweets, row.likes, row.views) == expected


def test_post_ids(spark):
    links = texts(spark, "https://x.example/u/status/1681508122635169792", "https://x.example/u/status/1681508122635169792/photo/1",
                  "https://x.example/u/status/not-a-number-at-all-no", None)
    assert column(links, entities.post_id_of(F.col("text"))) == [1681508122635169792, None, None, None]
    assert column(texts(spark, ""), entities.permalink("https://x.example/", F.col("id"))) == ["https://x.example/0"]


def test_markup(spark):
    page = ('<p>Hi <b>you</b> &amp; me</p><script>var a = "<p>no</p>";</script><!-- no -->'
            '<A class="k" href="/a">x</A><a href="/b">y</a><img src="s" alt="😀"><time datetime="2023-07-11T10:00:00Z">t</time>')
    pages = texts(spark, page)
    html = F.col("text")
    assert column(pages, markup.hrefs(html)) == [["/a", "/b"]]
    assert column(pages, markup.picture_labels(html)) == [["😀"]]
    assert column(pages, markup.visible_text(html)) == ["Hi you & me x y t"]
    assert column(pages, F.size(markup.times(html))) == [1]


def test_character_references(spark):
    cases = {
        "it&#8217;s &eacute;t&eacute; &#x1F600;&hellip;": "it\u2019s été 😀…", "&amp;lt; &amp;amp;": "&lt; &amp;", "a &amp b &copy 2024": "a & b © 2024",
        "&#150;&#x80; &#0;&#xD800; &#99999999999;": "\u2013€ \ufffd\ufffd \ufffd", "&NotAName; &; & &# &#x;": "&NotAName; &; & &# &#x;",
        "x&nbsp;&nbsp;y": "x y", "&nGt;&CounterClockwiseContourIntegral;": "\u226b\u20d2∳", "no reference": "no reference", "&#0000000038;": "&",
        "&amplifier &ltx": "&amplifier &ltx",
    }
    pages = texts(spark, *cases)
    assert column(pages, markup.visible_text(F.col("text"))) == list(cases.values())
    links = texts(spark, '<a href="?a=1&copy=2&amp;b=&eacute;&#233;"><img alt="&quot;&#x2764;&quot;">', None)
    assert column(links, markup.hrefs(F.col("text"))) == [["?a=1&copy=2&b=éé"], None]
    assert column(links, markup.picture_labels(F.col("text"))) == [['"❤"'], None]


def test_chunks_cover_the_text(spark):
    posts = texts(spark, "abcdefgh", "abcd", "", None)
    assert column(posts, chunk_text(F.col("text"), 4)) == [["abcd", "efgh"], ["abcd"], [], []]
    assert column(texts(spark, "abcde"), chunk_text(F.col("text"), 4)) == [["abcd", "e"]]


def test_diacritics(spark):
    assert column(texts(spark, "ÀéîõÜ Ł ø ß Æ"), strip_diacritics(F.col("text"))) == ["AeioU L o ss AE"]


def test_whole_emoji_have_names(spark):
    emoji = ["\U0001F469\u200d\U0001F4BB", "\U0001F1FA\U0001F1F8", "\U0001F44D\U0001F3FD", "\u2764\ufe0f", "\U0001F600"]
    frame = spark.createDataFrame([(emoji,)], "e array<string>")
    assert frame.select(emoji_names(F.col("e")).alias("n")).first().n == [
        "woman personal computer", "flag us", "thumbs up sign emoji modifier fitzpatrick type-4", "heavy black heart",
        "grinning face"]


def test_attributes_in_all_quotes(spark):
    html = F.lit("""<a class="x" href='/one?a=1&amp;b=2'>A</a><a href=/two>B</a><a title="a > b" href="/three">C</a>
        <a data-href="/no">D</a><IMG ALT='it is "so"'>""")
    found = spark.range(1).select(markup.hrefs(html).alias("h"), markup.picture_labels(html).alias("p"),
                                  markup.visible_text(html).alias("t")).first()
    assert found.h == ["/one?a=1&b=2", "/two", "/three"] and found.p == ['it is "so"'] and found.t == "AB C D".replace("AB", "A B")
