"""Golden cases of the text cleaners."""

from __future__ import annotations

from feedlake.functions import legacy, text


def check(values, fn, cases, schema="string"):
    got = values(fn, [c[0] for c in cases], schema)
    assert got == [c[1] for c in cases]


def test_title(values):
    check(
        values,
        text.normalize_title,
        [
            ("\t Harbour report\n", "Harbour report"),
            ("Ferry\r\n\r\nto \t\t the isle", "Ferry to the isle"),
            ("three   blanks    here", "three blanks here"),
            ("<h2 class='x'>Low tide</h2>", "Low tide"),
            ("A <i>very</i> <u>short</u> walk", "A very short walk"),
            ("Salt &amp; pepper", "Salt & pepper"),
            ("McKenna and the BBC", "McKenna and the BBC"),
            ("naïve", "naïve"),
            ("nai\u0308ve", "naïve"),
            ("oﬀice ②", "office 2"),
            (None, "Untitled Article"),
            ("", "Untitled Article"),
            (" \u00a0 ", "Untitled Article"),
            ("<p><br></p>", "Untitled Article"),
            ("if 1 < 2 then", "if 1 < 2 then"),
            ("left &lt;script&gt;right", "left right"),
            ("hard&nbsp;space", "hard space"),
            ("&Ouml;l &spades; &#x43;&#68;", "Öl ♠ CD"),
            ("R&D &notaword z", "R&D ¬aword z"),
            ("delete from orders", " orders"),
            ("stop; -- here", "stop here"),
            ("ends so --", "ends so "),
            ("UPDATE prices  then SET y", " y"),
            ('<q title="p>q" cite=z>m</q>', "m"),
            ("<!-- <li>hidden</li> -->seen", "seen"),
            ("<li>first</li><li>second</li>", "first second"),
        ],
    )


def test_summary(values):
    check(
        values,
        text.normalize_summary,
        [
            ("<div>Rain <b>over</b> <i>hills</i></div>", "Rain over hills"),
            ("<script>steal()</script><div>Calm sea</div>", "Calm sea"),
            ("Oil &amp; gas &lt;draft&gt; &quot;final&quot;", 'Oil & gas "final"'),
            ("<div>Rain\r\n\r\nover\t \thills</div>", "Rain over hills"),
            ("q" * 90_001, "q" * 4000),
            ("<input onfocus=steal()>", None),
            ("javascript:run(2)", "run(2)"),
            ("<iframe src='javascript:run(2)'></iframe>", None),
            ("Wind; DELETE FROM gauges; --", "Wind; gauges"),
            ("<script>top.location='//bad.example'</script>", None),
            ("precondition= set", "precondition= set"),
            ("wait onload = later", "wait later"),
            (None, None),
            ("", None),
            ("\t\n", None),
            ("&lt;script&gt;run(2)&lt;/script&gt;fine", "fine"),
            ("\U0001f30a wave" * 500, ("\U0001f30a wave" * 500)[:4000]),
        ],
    )


def test_author(values):
    check(
        values,
        text.normalize_author,
        [
            ("\t Ada Lindqvist ", "Ada Lindqvist"),
            (None, None),
            ("", None),
            ("\n ", None),
            ("<em>Ada Lindqvist</em>", "Ada Lindqvist"),
            ("u  v", "u  v"),
            ("\n Ada &amp; co.\t", "Ada & co."),
        ],
    )


def test_tags(values):
    check(
        values,
        text.normalize_tags,
        [
            (["Sea", "sea", "Harbour", "HARBOUR", "SEA"], ["Harbour", "Sea"]),
            (["tide", "kelp", "moor"], ["kelp", "moor", "tide"]),
            (["<b>Sea</b>", "Harbour"], ["Harbour", "Sea"]),
            (["d", "X", "Ö", "c", " ", ""], ["X", "c", "d", "Ö"]),
            (["B&amp;B", "B&B", "c&Ouml;d"], ["B&B", "cÖd"]),
            ([], []),
            (None, []),
        ],
        "array<string>",
    )


def test_nfkc_gate_matches_full_normalisation(values):
    import unicodedata

    samples = [
        "plain",
        "été",
        "é",
        "Ω ohm",
        "ＡＢ",
        "한",
        "ऩ",
        "x²",
        " ",
        "中文",
        "がが",
        "\U0001d400",
        "གྷ",
    ]
    assert values(text.nfkc, samples) == [unicodedata.normalize("NFKC", s) for s in samples]


def test_nfkc_gate_covers_every_bmp_character(spark):
    """Whatever the JVM gate calls stable really is unchanged, also in context."""
    import re
    import unicodedata

    unstable = re.compile(text._NFKC_UNSTABLE)
    for point in range(0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        if not unstable.search(char):
            assert unicodedata.normalize("NFKC", "a" + char) == "a" + char
            assert unicodedata.normalize("NFKC", char + char) == char + char


def test_unescape_gate_matches_full_decoding(values):
    import html

    samples = [
        "a &amp; b",
        "&amp;lt;",
        "&amp",
        "&ampx",
        "&copy2024",
        "&#38;lt;",
        "& ;",
        "&&amp;",
        "&#xZ;",
        "&quot;&apos;&#39;&nbsp;|",
        "&am",
        "&",
        "&hellip;&mdash;",
    ]
    assert values(text.unescape, samples) == [html.unescape(s) for s in samples]


def test_suspicious(values):
    assert values(text.is_suspicious, ["JavaScript", "calm", None, "prescription"]) == [
        True,
        False,
        False,
        True,
    ]


def test_deep_markup_does_not_overflow(values):
    big = "<a " + 'x="y>" ' * 50_000 + ">t</a>" + "<b " + "=" * 100_000 + ">u</b>"
    assert values(text.normalize_title, [big]) == ["tu"]


def test_legacy(values):
    check(
        values,
        legacy.sanitize_html,
        [
            ("<p>Tom &amp; Ann</p>", "Tom  Ann"),
            ("alert(1) onload= x", "1)  x"),
            ("UPDATE now", "now"),
            ("a < b", "a  b"),
            ("y" * 5000, "y" * 4000),
        ],
    )
    check(
        values,
        legacy.legacy_title,
        [
            ("Good -- Title", "Good  Title"),
            (None, "Untitled Article"),
            ("drop table x", " x".strip()),
        ],
    )
    check(values, legacy.legacy_text, [("<b></b>", None), (None, None), ("x", "x")])
    check(
        values, legacy.legacy_tags, [(["b", "a", "b", "<i></i>"], ["b", "a", "b"])], "array<string>"
    )
