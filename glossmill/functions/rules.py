"""Rule tables of the lexical jobs."""

from __future__ import annotations

# English suffix and replacement, in order of trial.
ENGLISH_SUFFIXES = [
    ("ches", "ch"),
    ("xes", "x"),
    ("ies", "y"),
    ("men", "man"),
    ("es", "e"),
    ("ves", "f"),
    ("ves", "fe"),
    ("es", ""),
    ("s", ""),
    ("ed", "e"),
    ("ed", ""),
    ("ied", "y"),
    ("ing", "e"),
    ("ing", ""),
    ("iest", "y"),
    ("ier", "y"),
    ("est", "e"),
    ("est", ""),
    ("er", "e"),
    ("er", ""),
]
# Fixed value: consonants whose doubling before a suffix is undone.
DOUBLED = "bdfgklmnprstvz"

# Japanese suffix, replacement and reason, in order of trial.
JAPANESE_SUFFIXES = """
られました る ichidan passive polite past
られます る ichidan passive polite
られた る ichidan passive past
られる る ichidan passive
られない る ichidan passive negative
られなかった る ichidan passive negative past
ませんでした る polite negative past
ません る polite negative
ました る polite past
ます る polite
わなかった う godan negative past
かなかった く godan negative past
がなかった ぐ godan negative past
さなかった す godan negative past
たなかった つ godan negative past
ななかった ぬ godan negative past
ばなかった ぶ godan negative past
まなかった む godan negative past
らなかった る godan negative past
わない う godan negative
かない く godan negative
がない ぐ godan negative
さない す godan negative
たない つ godan negative
なない ぬ godan negative
ばない ぶ godan negative
まない む godan negative
らない る godan negative
なかった る negative past
ない る negative
た る past
て る te-form
くなかった い i-adjective negative past
くない い i-adjective negative
かった い i-adjective past
くて い i-adjective te-form
います う godan polite
きます く godan polite
ぎます ぐ godan polite
します す godan polite
ちます つ godan polite
にます ぬ godan polite
びます ぶ godan polite
みます む godan polite
ります る godan polite
いませんでした う godan polite negative past
きませんでした く godan polite negative past
ぎませんでした ぐ godan polite negative past
しませんでした す godan polite negative past
ちませんでした つ godan polite negative past
にませんでした ぬ godan polite negative past
びませんでした ぶ godan polite negative past
みませんでした む godan polite negative past
りませんでした る godan polite negative past
いません う godan polite negative
きません く godan polite negative
ぎません ぐ godan polite negative
しません す godan polite negative
ちません つ godan polite negative
にません ぬ godan polite negative
びません ぶ godan polite negative
みません む godan polite negative
りません る godan polite negative
んだ む godan past
んだ ぶ godan past
んだ ぬ godan past
んで む godan te-form
んで ぶ godan te-form
んで ぬ godan te-form
った う godan past
った つ godan past
った る godan past
って う godan te-form
って つ godan te-form
って る godan te-form
いた く godan past
いて く godan te-form
いだ ぐ godan past
いで ぐ godan te-form
した す godan past
して す godan te-form
"""


def japanese_suffixes() -> list[tuple[int, str, str, str]]:
    """(order, suffix, replacement, reason)."""
    return [(i, *line.split(" ", 2)) for i, line in enumerate(JAPANESE_SUFFIXES.strip().split("\n"))]


# Source language codes that may be published, and as what.
PUBLISHED_LANGUAGES = {"eng": "en", "zh-tw": "zh-tw", "zh-cn": "zh-cn", "ko": "ko"}
# Languages that explain each dictionary.
EXPLAINED_IN = {"ja": ["en", "de", "zh-tw", "zh-cn", "ko", "ja"], "en": ["en", "ja", "zh-tw"]}

# Sense categories that mark a page as an inflected form.
FORM_CATEGORIES = ["Plurals", "Past tense forms", "Past participles", "Present participles", "Third-person singular forms", "Comparative forms", "Superlative forms"]
# Names of inflections as glosses state them.
INFLECTIONS = ["plural", "past tense", "past participle", "present participle", "third[- ]person singular", "comparative", "superlative"]

# Part-of-speech names.
WORDNET_POS = {"n": "noun", "v": "verb", "a": "adjective", "s": "adjective", "r": "adverb"}
WIKTIONARY_POS = {"adj": "adjective", "adv": "adverb", "prep": "preposition", "pron": "pronoun"}
NO_POS = ["name", "proper noun", "proper-noun", "character", "punctuation", "symbol"]

# Tags by what they say of a sense.
REGISTERS = ["formal", "informal", "colloquial", "slang", "vulgar", "humorous", "literary"]
REGIONS = {"General-American": "US", "American": "US", "US": "US", "British": "UK", "UK": "UK", "Australian": "AU", "Canadian": "CA", "Ireland": "IE", "Irish": "IE"}
DOMAINS = ["sports", "medicine", "law", "computing", "finance", "linguistics", "chemistry", "physics"]
DATED = ["archaic", "dated", "obsolete", "historical"]
USAGE = ["transitive", "intransitive", "countable", "uncountable", "ergative"]

# Language codes of translation evidence.
JAPANESE_CODES = ["ja", "jpn", "ja-hira", "ja-kana"]
CHINESE_CODES = ["zh", "cmn", "zh-hant", "zh-hans", "zh-tw", "zh-cn", "nan", "nan-hbl", "nan-tw", "yue", "hak"]

# Sources by what they may be used for, and the reasons of the import gate.
RESTRICTED_SOURCES = ["ntu-chinese-wordnet"]
SUPPORTING_SOURCES = ["jmdict-reverse", "cc-cedict", "chinese-wordnet-simplified", "wiktionary-en-translations"]
REASON_RESTRICTED = "restricted-source-requires-a-documented-permission-grant"
REASON_SUPPORTING = "source-is-supporting-evidence-only"
REASON_MATCH = "match-is-not-an-exact-source-identifier-or-explicit-mapping"
REASON_STRUCTURE = "source-has-no-target-language-sense-structure"
REASON_LOCALE = "record-locale-does-not-match-the-target-locale"
REASON_LICENSE = "no-recorded-redistribution-license"
REASON_ATTRIBUTION = "no-recorded-attribution"
REASON_PROVENANCE = "incomplete-provenance"

# Reasons for leaving out concept evidence.
NOT_JAPANESE = "record-is-not-japanese"
NO_MAPPING = "no-princeton-wordnet-ili-mapping"
NOT_VALIDATED = "princeton-wordnet-ili-mapping-is-not-validated"

# Reasons for flagging or leaving out translation evidence.
MULTIPLE_TERMS = "multiple-terms-in-one-record"
NO_SINGLE_SENSE = "entry-level-record-cannot-be-attributed-to-one-sense"

# The fields a terminology record must have.
TERMINOLOGY_FIELDS = ["agency", "dataset", "domain", "version", "attribution", "english", "chinese"]

# Level names from easiest to hardest.
LEVELS = ["N5", "N4", "N3", "N2", "N1"]
