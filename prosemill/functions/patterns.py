"""The boundary model as data: states, seam patterns, what each seam does and what it is called.

The same tables drive the scanner that runs in Python workers and the SQL that states
its results, so every pattern is written in syntax that Python and RE2 read alike.
"""

from __future__ import annotations

OPENERS = "\"'“‘([{"
STATES = (
    "Narrative",
    "DialogDoubleQuote",
    "DialogSingleQuote",
    "DialogSmartDoubleOpen",
    "DialogSmartSingleOpen",
    "DialogParenthheticalRound",
    "DialogParenthheticalSquare",
    "DialogParenthheticalCurly",
)
#: The state that each opener begins.
STATE_OF = {o: k + 1 for k, o in enumerate(OPENERS)}
CLOSERS = {1: '"', 2: "'", 3: "”", 4: "’", 5: r"\)", 6: r"\]", 7: r"\}"}

#: Unicode White_Space; U+001C to U+001F, which Python counts too, are not in it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_END, _SOFT, _GAP, _BREAK, _HARD = "[.!?]", "[,:;]", "[ \t]+", r"\r?\n", r"(?:\r\n\r\n|\n\n)"
_OPEN = r"[\"'“‘(\[{]"
_SHUT_OUT = r"[^\"'“‘(\[{]"
_START, _LOWER = r"[A-Z\"'“‘(\[{]", r"[^A-Z\"'“‘(\[{]"
_ONE = [r"\"", "'", "“", "‘", r"\(", r"\[", r"\{"]

SPLIT, OPEN, CLOSE, SOFT, HARD = "split", "open", "close", "soft", "hard"
#: Joints that end a sentence when they are followed.
SPLITTING = (SPLIT, CLOSE, HARD)
#: Next state where the seam's own text tells it.
BY_LAST, BY_SECOND_LAST = -1, -2


def _narrative():
    out = [(f"{_END}{_GAP}{o}", SPLIT, k + 1, f"NarrativeToDialog[{k}]") for k, o in enumerate(_ONE)]
    out += [(f"{_SOFT}{_GAP}{o}", OPEN, k + 1, f"DialogOpen[{k}]") for k, o in enumerate(_ONE)]
    out += [(f"[ \t\n]{o}", OPEN, k + 1, f"IndependentDialog[{k}]") for k, o in enumerate(_ONE)]
    out += [
        (f"{_END}{_BREAK}[A-Z]", SPLIT, 0, "NarrativeLineBoundary"),
        (f"{_END}{_GAP}[A-Z]", SPLIT, 0, "NarrativeSentenceBoundary"),
        (rf"{_END}\s*{_HARD}\s*[A-Z]", SPLIT, 0, "NarrativeHardBoundary"),
    ]
    return out + _breaks()


def _breaks():
    return [
        (_HARD + _OPEN, HARD, BY_LAST, "HardSepDialogStart"),
        (_HARD + _SHUT_OUT, HARD, BY_LAST, "HardSepNarrativeStart"),
        (_HARD, HARD, BY_LAST, "HardSepEOF"),
    ]


def _dialog(state):
    c = CLOSERS[state]
    if state == 1:
        return _breaks() + [
            (f"{c}{_GAP}{_OPEN}[A-Z]", CLOSE, BY_SECOND_LAST, "DialogToDialogHard"),
            (f"{c}{_GAP}{_OPEN}[^A-Z]", OPEN, BY_SECOND_LAST, "DialogToDialogSoft"),
            (f"{_END}{c}{_GAP}[A-Z]", CLOSE, 0, "DialogHardEnd"),
            (f"{_END}{c}{_GAP}{_LOWER}", SOFT, 0, "DialogSoftEnd"),
            (f"{_SOFT}{c}{_GAP}{_START}", SOFT, 0, "DialogContinuationBefore"),
            (f"{c}{_SOFT}{_GAP}{_START}", SOFT, 0, "DialogContinuationAfter"),
            (f"{c}{_GAP}[A-Z]", CLOSE, 0, "DialogUnpunctuatedHardEnd"),
            (f"{c}{_GAP}{_LOWER}", SOFT, 0, "DialogUnpunctuatedSoftEnd"),
        ]
    if state == 5:
        # Punctuation stands outside round brackets; names lag behind the patterns from the eighth on.
        return _breaks() + [
            (f"{c}{_END}{_GAP}{_START}", CLOSE, 0, "DialogHardEnd"),
            (f"{c}{_END}{_GAP}{_LOWER}", SOFT, 0, "DialogSoftEnd"),
            (f"{_SOFT}{c}{_GAP}{_START}", SOFT, 0, "DialogContinuationBefore"),
            (f"{c}{_SOFT}", SOFT, 0, "DialogNonSentencePunct"),
            (f"{c}{_SOFT}{_GAP}{_START}", SOFT, 0, "DialogUnpunctuatedHardEnd"),
            (f"{c}{_GAP}{_START}", CLOSE, 0, "DialogUnpunctuatedSoftEnd"),
            (f"{c}{_GAP}{_LOWER}", SOFT, 0, "Unknown[9]"),
        ]
    return _breaks() + [
        (f"{_END}{c}{_GAP}{_START}", CLOSE, 0, "DialogHardEnd"),
        (f"{_END}{c}{_GAP}{_LOWER}", SOFT, 0, "DialogSoftEnd"),
        (f"{_SOFT}{c}{_GAP}{_START}", SOFT, 0, "DialogContinuationBefore"),
        (f"{c}{_SOFT}{_GAP}{_START}", SOFT, 0, "DialogContinuationAfter"),
        (f"{c}{_GAP}{_START}", CLOSE, 0, "DialogUnpunctuatedHardEnd"),
        (f"{c}{_GAP}{_LOWER}", SOFT, 0, "DialogUnpunctuatedSoftEnd"),
    ]


#: By state, ordered joints: (pattern, effect, next state, name). The first that matches leftmost wins.
JOINTS = [_narrative(), *(_dialog(s) for s in range(1, 8))]

QUOTES = "\"'“”‘’"
TITLES = tuple(
    sorted(
        {f"{chr(c)}." for c in range(65, 91)}
        | {w + "." for w in "Adm Ald Amb Capt Cmdr Col Cpl Dr Ens Fr Gen Gov Hon Jr Lt Maj Messrs Mlle Mme Mr Mrs Ms Msgr Pres Prof Pvt Rab Rep Rev Sen Sgt Sr St Supt".split()}
    )
)
#: The seven titles that the dictionary segmenter knows.
FEW_TITLES = ("Dr.", "Jr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Sr.")
#: Abbreviations beyond titles, for checks of words.
OTHER_ABBREVIATIONS = tuple(sorted({"et al."} | {w + "." for w in "D.C L.A N.Y.C U.K U.S.A a.m deg ea etc ft in km lbs mi oz p.m vs".split()}))

#: After these a paragraph break ends a sentence; after those it doesn't. Anything else ends it too.
BREAK_REJECTED = ",;:-/([{—–“‘…"
#: Bytes that are looked back over from a paragraph break.
LOOK_BACK = 20
#: Bytes of context on both sides of a seam in a trace.
CONTEXT = 10
#: After one of these, white space begins a separator.
BEFORE_GAP = ".!?\"')]}>"
