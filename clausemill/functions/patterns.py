"""Regular expressions and word lists, each spelled once and rendered for Spark (Java) or for an RE2 engine.

``<<`` marks a word start and ``>>`` a word end in the ASCII sense.  Java's own
``\\b`` also counts letters such as ``ü``, so Spark gets look-arounds instead.
``WS`` is white space in the wide sense: no-break spaces and U+FEFF included.
"""

from __future__ import annotations

WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The characters of ``WS``.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def java(pattern: str) -> str:
    """Without flags, Java's ``\\w`` is the ASCII word character.  A word and the space after it are never given back: no match could end inside them."""
    pattern = pattern.replace(r"\w+(?:WS)+", r"\w++(?:WS)++").replace("(?<=[A-Za-z0-9_])", r"(?<=\w)")
    return pattern.replace("<<", r"(?<!\w)(?=\w)").replace(">>", r"(?<=\w)(?!\w)").replace("WS", WS)


def re2(pattern: str) -> str:
    return pattern.replace("<<", r"\b").replace(">>", r"\b").replace("WS", WS)


# --- Fixed values: wording that asks for everything (tried first), then wording that asks whether something is there.
COMPLETENESS = (
    ('"list all"', r"(?i)<<list (?:all|every|each|the)>>"),
    ('"all the"', r"(?i)<<all (?:of )?the>>"),
    ('"every"', r"(?i)<<every>>"),
    ('"each clause"', r"(?i)<<each (?:of the )?(?:clause|party|obligation|payment|deadline)"),
    ('"how many"', r"(?i)<<how many>>"),
    ('"summarise the whole document"', r"(?i)<<(?:summar(?:ise|ize)|overview) (?:the )?(?:whole|entire|full|document|contract|agreement)>>"),
    ('"complete list"', r"(?i)<<complete list>>"),
    ('"find all"', r"(?i)<<find all>>"),
    ('"all clauses"', r"(?i)<<all (?:clauses|provisions|sections|obligations|parties|dates|deadlines|amounts)>>"),
)
_CONTAIN = r"does (?:it|the \w+) (?:contain|include|mention|have|specify|say|provide|cover)>>"
_CONTAIN_DOC = r"do(?:es)? (?:the )?(?:document|contract|agreement|lease)s? (?:contain|include|mention|have)>>"
EXISTENCE = (
    ('"is there"', r"(?i)<<is there>>"),
    ('"are there"', r"(?i)<<are there>>"),
    ('"does it contain"', r"(?i)<<" + _CONTAIN),
    ('"does the document contain"', r"(?i)<<" + _CONTAIN_DOC),
    ('"any … clause(s)"', r"(?i)<<any>>[^?.]{0,40}<<(?:clause|provision|section|term|mention|reference|right|obligation)s?>>"),
    ('"is there a"', r"(?i)<<(?:is|are) (?:it|there|they) (?:any|a)>>"),
    ('"are any"', r"(?i)<<(?:is|are|was|were) any>>"),
    ('"… included?"', r"(?i)<<(?:included|present|covered|addressed)WS*\?"),
    ('"missing"', r"(?i)<<missing>>"),
    ('"omitted"', r"(?i)<<omitted>>"),
    ('"without a"', r"(?i)<<without (?:a|any)>>"),
    ('"no clause"', r"(?i)<<no (?:clause|provision|mention)>>"),
    ('"whether it contains"', r"(?i)<<whether>>.{0,40}<<(?:contains|includes|mentions|has)>>"),
)
#: Occurrences after "what" or "how" do not count for these two rules; they are blanked before the test.
GUARDED = {'"does it contain"': r"(?i)<<(?:what|how)WS+" + _CONTAIN, '"does the document contain"': r"(?i)<<(?:what|how)WS+" + _CONTAIN_DOC}
SPECIFIC = "no existence or completeness wording"

# --- Fixed values: answers that report absence, and claims of absence.
NOT_FOUND = (
    r"(?i)<<not (?:found|present|stated|specified|mentioned|included|addressed)>>",
    r"(?i)<<(?:could|can)(?:not|'t) (?:find|locate|determine)>>",
    r"(?i)<<do(?:es)? not (?:appear|contain|mention|specify|state|address|include|provide)>>",
    r"(?i)<<no (?:information|mention|reference|provision|clause|answer)>>",
    r"(?i)<<is not (?:covered|dealt with)>>",
    r"(?i)<<the (?:excerpts|sections|document) (?:provided )?do(?:es)? not>>",
    r"(?i)<<I (?:could not|couldn't|cannot|can't) find>>",
)
ABSENCE = (
    r"(?i)<<does not (?:contain|include|mention|have|specify|provide)>>",
    r"(?i)<<there is no>>",
    r"(?i)<<there are no>>",
    r"(?i)<<no such (?:clause|provision|section|term)>>",
    r"(?i)<<is not (?:present|included|mentioned|specified)>>",
    r"(?i)<<the (?:document|agreement|contract) (?:does not|doesn't)>>",
    r"(?i)<<not found anywhere>>",
    r"(?i)<<no mention of>>",
)

# --- Fixed values: search words that narrow nothing down.
STOP_WORDS = (
    "the and for are any what which does has have was were this that there with from about into can will shall may all how who whom "
    "when where why its their they you your our per under such other each both been being said agreement contract document clause section"
).split()

# --- Fixed values: the usual stop words of English full-text search.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now"
).split()

# --- Fixed values: topics that make a clause critical, and what the change detectors look for.
CRITICAL_TOPICS = ("liability", "indemn", "payment", "fee", "penalty", "penalties", "termination", "confidential", "governing law", "jurisdiction")
MONEY = r"(?i)(?=[AUEGD$])(?:<<(?:AED|USD|EUR|GBP|Dhs|Dirhams)|(?<=[A-Za-z0-9_])\$)WS*[0-9,]+(?:\.[0-9]+)?>>"
MONEY_RE2 = r"(?i)\b(?:AED|USD|EUR|GBP|\$|Dhs|Dirhams)WS*[0-9,]+(?:\.[0-9]+)?\b"
PERCENT = r"(?i)<<[0-9]+(?:\.[0-9]+)?WS*(?:%|per(?:WS)+cent(?:\.|>>))"
DURATION = r"(?i)<<(?:\w+(?:WS)+)?(?:\((?:WS)*[0-9]+(?:WS)*\)|[0-9]+)(?:WS)*(?:days?|months?|years?|weeks?|hours?)>>"
LAW = r"<<(DIFC|ADGM|Dubai|Abu Dhabi|England and Wales)>>"
MANDATORY, OPTIONAL = r"(?i)<<(?:shall|must)>>", r"(?i)<<may>>"

# --- Fixed values: shapes of headings, tried in this order.
HEADINGS = (
    ("article", r"^(ARTICLE|Article)(?:WS)+([IVXLCDM]+|[0-9]+)>>[.:–—-]?(?:WS)*(.*)$"),
    ("section", r"^(SECTION|Section)(?:WS)+([0-9]+(?:\.[0-9]+)*)>>[.:–—-]?(?:WS)*(.*)$"),
    ("numbered", r"^([0-9]+(?:\.[0-9]+)*)\.?(?:WS)+([^\t-\r \x{A0}].*)$"),
    ("lettered", r"^\(([a-z]{1,3}|[ivxlcdm]{1,5})\)(?:WS)+([^\t-\r \x{A0}].*)$"),
)
#: The characters that a heading of each shape begins with.
HEADING_STARTS = {"article": "A", "section": "S", "numbered": "0123456789", "lettered": "("}

# --- Fixed values: instructions that ask for more than wording.
SCOPE_START, SCOPE_WORDS = ("add a new", "insert a new"), ("new clause", "new section", "new paragraph")
FORMAT_START, FORMAT_WORDS = ("format ",), ("bold", "italic", "underline", "font")
OUT_OF_SCOPE_NEW = "OUT_OF_SCOPE: Inserting entire new clauses or paragraphs is not supported."
OUT_OF_SCOPE_FORMAT = "OUT_OF_SCOPE: Formatting-only changes (bold, italics, styling) are not supported."
