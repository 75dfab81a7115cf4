"""Template residue, filler and error pages by rule (problem 10).

Unfilled fields and filler may stand anywhere in a text of its own, so a rule on the text finds them; whole texts
that resemble each other are found by residue_neighbours. A text is an error page or a demand to allow scripts if,
without its menu and such messages, one short sentence at most is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a sentence that still counts as short beside a message.
SHORT_SENTENCE = 12

_I = regex.IGNORECASE
#: Names of any length: with spaces, where a doubled or braced notation closes them; in one piece.
_NAME = r"[\p{L}_$][\p{L}\p{M}\p{N}_.$ -]*+"
_TIGHT = r"[\p{L}_][\p{L}\p{M}\p{N}_.]*+"
#: Names in signs that prose has, too: six words at most, each of any length; but 42 characters in a row of a script that parts words by no spaces are prose.
_PROSE = r"(?![\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\U00020000-\U0003FFFF]{42})"  # Thai, Lao, Burmese, Khmer, kana, Han
_WORDS = rf"{_PROSE}[\p{{L}}_$][\p{{L}}\p{{M}}\p{{N}}_.$-]*+(?: ++[\p{{L}}\p{{M}}\p{{N}}_.$-]++){{0,5}}"

#: Fields of common template languages that were never filled in. Fixed patterns.
FIELDS = regex.compile(
    "|".join([
        rf"\{{\{{[{{#/&^!>]?\s*{_NAME}(?:\|[^{{}}\n]*)?\s*\}}\}}",  # {{ name }}
        rf"[$#]\{{\s*{_NAME}\s*\}}",  # ${name}, #{name}
        rf"(?<![\p{{L}}\p{{N}}{{])\{{\s*\$?(?:{_TIGHT}|\d)\s*\}}(?!\}})",  # {name}, {$name}, {0}
        r"\{%-?\s*[\p{L}_][^%{}\n]*%\}",  # {% include 'name' %}
        r"<%[=-]?\s*[^%<>\n]+%>",  # <%= name %>
        r"<\?(?:=|php)\s*[^<>\n]*?\?>",  # <?= $name ?>
        rf"<<\s*{_WORDS}\s*>>",
        rf"«\s*{_PROSE}{_TIGHT}\s*»",
        rf"\[\[\s*{_WORDS}\s*\]\]",
        r"(?<!\w)__[\p{L}_][\p{L}\p{M}\p{N}_.]{0,40}__(?!\w)",  # longer ones: _LONG_UNDERSCORED
        rf"@@{_TIGHT}@@",
        rf"##{_TIGHT}##",
        rf"(?<![\w%])%{_TIGHT}%(?![\w%])",
        rf"%\({_TIGHT}\)[sdrfi]",
        r"(?<![\w%])%[sdif](?![\w%])",
        r"<\s*(?:insert|enter|add|your)\b[^<>\n]*>",
        r"\[\s*(?:insert|enter|add|your)\b[^\[\]\n]*\]",
        rf"\[(?!object\b){_PROSE}{_TIGHT}\](?!\()",  # [name]
    ]),
    _I,
)

#: __NAME__ of any length, from a run's first underscores before a letter, so that each run is gone through once; a line of underscores is none.
_LONG_UNDERSCORED = regex.compile(r"(?<![\p{L}\p{M}\p{N}_.])(?>[\p{L}\p{M}\p{N}_.]*?(?<!\w)__(?=\p{L}))[\p{L}\p{M}\p{N}_.]*[\p{L}\p{M}\p{N}]__(?!\w)")

#: What templates print for a value that is missing. Fixed patterns, in the case in which programs print them.
MISSING = regex.compile(
    r"(?<!\S)(?:undefined|null|None|NaN|NULL|nil|\(null\)|\(undefined\)|\(none\)|\[object [A-Z]\w+\]|Invalid Date|N/A N/A|\?{3}|X{4,}|TBD|NaT|#(?:REF!|N/A|VALUE!|NAME\?|DIV/0!|NUM!|NULL!))(?=[\s.,;:!?।]|$)"
)
#: Words around such a value in sentences that speak of it. Fixed patterns.
_SPOKEN = regex.compile(r"(?:\b(?:value|variable|term|result|entry|word|field|it)\s+(?:is|was|were|are|be)\s+(?:undefined|null)\b|\b(?i:null (?:given|pointer|hypothesis|and void))\b|\b(?i:(?:property|index) of (?:null|undefined))\b|\bNone of\b)")

#: Passages in which a field is quoted, explained or shown: code marks, quotation marks, f-strings, forms on paper. Fixed patterns.
QUOTED = regex.compile(
    r"`[^`\n]*`|“[^”\n]*”|‘[^’\n]*’|„[^“\n]*“|f?\"[^\"\n]*\"|f?(?<!\w)'[^'\n]*'(?!\w)|\b(?:fill|write|enter|put)(?: in)? [\[<{][^\]>}\n]*[\]>}] (?:in|on|into|at) "
    , _I
)

#: The vocabulary of the usual Latin filler; a run of four of its words is filler. Fixed values.
_LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()

#: Sentences that stand in place of content, in English and the languages of the corpus. Fixed values.
FILLERS = regex.compile(
    r"(?<!\w)(?:" + "|".join([
        rf"(?:(?:{'|'.join(_LATIN)})\W+){{3,}}(?:{'|'.join(_LATIN)})(?!\w)",
        r"(?:text )(?:text\W+){1,}text", r"(?:blah\W+){2,}blah", r"(?:asdf\W+){2,}", r"asdf\W+qwer", r"qwerty\W+qwerty", r"(?:test\W+){2,}(?:\d+\W+test)?", r"foo\W+bar\W+baz",
        r"(?:content|text|description|details|more) coming soon", r"coming soon\W*$", r"(?:sample|placeholder|dummy|filler) (?:text|content|paragraph|sentence) goes here", r"placeholder (?:text|paragraph|content|image)",
        r"(?:your|the|a) (?:text|heading|headline|title|content|name|subtitle|caption|description)s? (?:goes )?here", r"type something", r"add (?:a|an|your|some) (?:short |brief )?(?:description|text|title|caption|heading|content)",
        r"this is (?:a |some )?(?:dummy|sample|placeholder|test) (?:text|content|paragraph|page)", r"click (?:here )?to edit(?: this text)?", r"enter (?:your )?(?:text|title) here",
        # Hindi, Marathi
        "यह एक नमूना (?:पाठ|लेख|वाक्य) है", "शीर्षक यहाँ आएगा", "(?:यहाँ|यहां) अपना (?:पाठ|शीर्षक|नाम) लिखें", "विवरण (?:बाद में|जल्द) जोड़ा जाएगा", "हा नमुना मजकूर आहे", "शीर्षक येथे येईल", "येथे तुम(?:चा|चे) (?:मजकूर|नाव) लिहा", "(?:तपशील|वर्णन|माहिती) (?:नंतर|लवकरच) (?:जोडला|जोडले|जोडली) जाईल",
        # Gujarati
        "આ નમૂનાનું લખાણ છે", "શીર્ષક અહીં આવશે", "અહીં તમારું (?:લખાણ|નામ) લખો", "(?:વિગત|વિગતો|વર્ણન|માહિતી) (?:પછી|ટૂંક સમયમાં) ઉમેરવામાં આવશે",
        # Malayalam, Kannada
        "ഇത് ഒരു മാതൃകാ വാചകമാണ്", "തലക്കെട്ട് ഇവിടെ വരും", "നിങ്ങളുടെ (?:വാചകം|പേര്) ഇവിടെ എഴുതുക", "വിവരണം (?:പിന്നീട്|ഉടൻ) ചേർക്കും", "ಇದು ಮಾದರಿ ಪಠ್ಯ", "ಶೀರ್ಷಿಕೆ ಇಲ್ಲಿ ಬರುತ್ತದೆ", "ನಿಮ್ಮ (?:ಪಠ್ಯವನ್ನು|ಹೆಸರನ್ನು) ಇಲ್ಲಿ ಬರೆಯಿರಿ", "ವಿವರಣೆಯನ್ನು (?:ನಂತರ|ಶೀಘ್ರದಲ್ಲೇ) ಸೇರಿಸಲಾಗುವುದು",
        # Odia
        "ଏହା ଏକ ନମୁନା (?:ପାଠ|ଲେଖା)(?: ଅଟେ)?", "ଶୀର୍ଷକ ଏଠାରେ ଆସିବ", "ଏଠାରେ ଆପଣଙ୍କ (?:ପାଠ|ଲେଖା|ନାମ) ଲେଖନ୍ତୁ", "(?:ବିବରଣୀ|ବିବରଣ) (?:ପରେ|ଶୀଘ୍ର) (?:ଯୋଡ଼ାଯିବ|ଯୋଡାଯିବ)",
    ]) + r")(?!\p{M})",
    _I | regex.MULTILINE,
)

_SCRIPT = r"(?:java\s?script|\bjs\b|scripts?\b|scripting|cookies?\b|जावास्क्रिप्ट|स्क्रिप्ट|कुकी|જાવાસ્ક્રિપ્ટ|સ્ક્રિપ્ટ|કૂકી|ജാവാസ്ക്രിപ്റ്റ്|സ്ക്രിപ്റ്റ്|കുക്കി|ಜಾವಾಸ್ಕ್ರಿಪ್ಟ್|ಸ್ಕ್ರಿಪ್ಟ್|ಕುಕೀ|ଜାଭାସ୍କ୍ରିପ୍ଟ|ସ୍କ୍ରିପ୍ଟ|କୁକି)"

#: Messages of servers, programs and scripts in place of content, sentence by sentence. Fixed patterns.
MESSAGES = regex.compile(
    "|".join([
        _SCRIPT,
        r"\b(?:error|http|code|status|http/1\.1)\W{0,2}\d{3,4}\b", r"^\W*\d{3,4}\W+(?:not found|forbidden|bad gateway|unauthorized|bad request|gone|gateway time|internal server|service unavailable|too many)", r"\b(?:page|url|file|resource|document|site)\b.{0,40}\b(?:not (?:be )?found|not available|unavailable|rejected|no longer exists|does ?n.t exist|has moved|has expired)",
        r"\b(?:not found|forbidden|access denied|bad gateway|service unavailable|too many requests|unauthorized|internal server error|gateway time-?out|permission denied)\b", r"do(?:es)? not have permission", r"no (?:search )?results", r"nothing matched your", r"session (?:has )?expired", r"log in again", r"(?:connection|request|gateway) (?:has )?timed out",
        r"error establishing", r"something went wrong", r"^\W*oops\b", r"^\W*sorry\W*$", r"try again (?:later|in)|please try again", r"retry after", r"limit of \d+ reached|rate limit|quota exceeded", r"support id", r"^\W*ref(?:erence)?\W{0,3}#?[\dA-F-]+\W*$", r"checking your browser|verify(?:ing)? (?:that )?you are (?:a )?human", r"this may take (?:up to )?\d+", r"^\W*loading\W*$", r"switch it on and reload|turn it on and reload|reload the page",
        r"traceback \(most recent call", r"\bfile \"[^\"]+\", line \d+", r"\b\w*(?:error|exception)\s*:\s", r"^\s*[\w.]+(?:exception|error)\s*$", r"^\s*at [\w.$<>]+\([\w.]+:\d+\)", r"\bsqlstate\b", r"base table or view", r"mysqli?_\w+\(|expects parameter", r"\bfatal error\b|uncaught \w*error|cannot read propert", r"stack trace", r"\bon line \d+\b", r"segmentation fault|core dumped", r"no such file or directory",
        # Hindi, Marathi
        "(?:पृष्ठ|पेज|पान) (?:नहीं मिला|उपलब्ध नहीं|सापडले नाही|उपलब्ध नाही)", "अनुमति नहीं", "गड़बड़ी हुई", "(?:बाद में|नंतर) (?:प्रयास|प्रयत्न)", "त्रुटि \\d+", "त्रुटी \\d+", "(?:सर्वर|सर्व्हर).{0,20}(?:त्रुटि|त्रुटी|गड़बड़)", "प्रवेश (?:नाही|वर्जित|निषिद्ध)", "उपलब्ध (?:नहीं|नाही)", "क्षमा करें|क्षमस्व", "(?:सत्र|सेशन).{0,20}(?:समाप्त|संपल)",
        # Gujarati
        "(?:પૃષ્ઠ|પાનું|પેજ) (?:મળ્યું નથી|ઉપલબ્ધ નથી)", "સર્વર ભૂલ", "પછી પ્રયાસ", "માફ કરશો", "ભૂલ \\d+", "(?:પરવાનગી|મંજૂરી|પ્રવેશ) નથી", "ઉપલબ્ધ નથી",
        # Malayalam, Kannada
        "പേജ് (?:കണ്ടെത്തിയില്ല|ലഭ്യമല്ല)", "അനുമതിയില്ല", "സെർവർ പിശക്", "പിന്നീട് ശ്രമിക്കുക", "ക്ഷമിക്കണം", "പിശക് \\d+", "ലഭ്യമല്ല", "ಪುಟ (?:ಕಂಡುಬಂದಿಲ್ಲ|ಲಭ್ಯವಿಲ್ಲ)", "ಸರ್ವರ್ ದೋಷ", "ನಂತರ ಪ್ರಯತ್ನಿಸಿ", "ಕ್ಷಮಿಸಿ", "ದೋಷ \\d+", "ಅನುಮತಿ ?(?:ಇಲ್ಲ|ಯಿಲ್ಲ)", "ಲಭ್ಯವಿಲ್ಲ",
        # Odia
        "ପୃଷ୍ଠା (?:ମିଳିଲା ନାହିଁ|ଉପଲବ୍ଧ ନାହିଁ)", "ସର୍ଭର.{0,20}ତ୍ରୁଟି", "ପରେ ଚେଷ୍ଟା", "କ୍ଷମା କରିବେ|କ୍ଷମା କରନ୍ତୁ", "ତ୍ରୁଟି \\d+", "ଅନୁମତି ନାହିଁ", "ଉପଲବ୍ଧ ନାହିଁ",
    ]),
    _I,
)

#: A menu: short entries between bars, arrows or bullets.
_MENU = regex.compile(r"^[^.!?।\n]+(?:\s[|»›•·/]\s[^|.!?।\n]+){1,}$")
_HOME = r"(?:Home|Main page|Start|मुख्य पृष्ठ|मुख्यपृष्ठ|મુખ્ય પાનું|പ്രധാന താൾ|ಮುಖಪುಟ|ମୁଖ୍ୟ ପୃଷ୍ଠା|[\p{L}\p{M}]+)"
_MENU_INSIDE = regex.compile(rf"{_HOME}(?: \| [\p{{L}}\p{{M}}]+(?: [\p{{L}}\p{{M}}]+)?)+ \| [\p{{L}}\p{{M}}]+", _I)
_SENTENCE = regex.compile(r"\n+|(?<=[.!?।…])\s+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


#: Every field has one of these signs, every printed value and every filler one of these parts; texts without are passed over.
#: No part holds a space, as a quoted passage may stand there, which is taken out before the rules are tried.
_FIELD_SIGN = regex.compile(r"[{\[<«%@#]|__")
_MISSING_PARTS = ("undefined", "null", "None", "NaN", "NULL", "nil", "(none)", "[object", "Invalid", "N/A", "???", "XXXX", "TBD", "NaT", "#")
_FILLER_PARTS = (
    *(w for w in _LATIN if len(w) > 4), "text", "blah", "asdf", "qwer", "test", "foo", "soon", "sample", "placeholder", "dummy", "filler", "something", "heading", "headline", "title", "content", "name", "caption", "description", "edit",
    "नमूना", "नमुना", "शीर्षक", "अपना", "विवरण", "मजकूर", "तुमचा", "तुमचे", "तपशील", "वर्णन", "माहिती", "નમૂના", "શીર્ષક", "તમારું", "વિગત", "વર્ણન",
    "માહિતી", "മാതൃകാ", "തലക്കെട്ട്", "നിങ്ങളുടെ", "വിവരണം", "ಮಾದರಿ", "ಶೀರ್ಷಿಕೆ", "ನಿಮ್ಮ", "ವಿವರಣೆ", "ନମୁନା", "ଶୀର୍ଷକ", "ଏଠାରେ", "ବିବରଣ",
)
#: The other words of the Latin filler stand in many texts; filler without any longer one has four of them.
_SHORT_LATIN = regex.compile(rf"(?<!\w)(?:{'|'.join(w for w in _LATIN if len(w) <= 4)})", _I)


#: Every message has one of these parts in lower case; sentences without are passed over.
_MESSAGE_PARTS = (
    "script", "js", "cookie", "error", "http", "code", "status", "not ", "n't ", "page", "url", "file", "resource", "document", "site", "forbidden", "denied", "gateway", "unavailable", "too many", "unauthorized", "bad request",
    "gone", "internal server", "permission", "no results", "no search", "matched", "session", "log in again", "timed out", "went wrong", "oops", "sorry", "try again", "retry", "limit", "quota", "support id", "ref",
    "checking", "verify", "may take", "loading", "reload", "traceback", "exception", "at ", "sqlstate", "base table", "mysql", "expects", "uncaught", "cannot read", "stack trace", "on line", "segmentation",
    "core dumped", "no such", "स्क्रिप्ट", "कुकी", "સ્ક્રિપ્ટ", "કૂકી", "സ്ക്രിപ്റ്റ്", "കുക്കി", "ಸ್ಕ್ರಿಪ್ಟ್", "ಕುಕೀ", "ସ୍କ୍ରିପ୍ଟ", "କୁକି", "नहीं मिला", "उपलब्ध", "सापडले", "अनुमति", "गड़बड़", "प्रयास", "प्रयत्न", "त्रुटि", "त्रुटी", "प्रवेश", "क्षमा",
    "क्षमस्व", "सत्र", "सेशन", "મળ્યું નથી", "ઉપલબ્ધ", "સર્વર", "પછી પ્રયાસ", "માફ", "ભૂલ", "પરવાનગી", "મંજૂરી", "પ્રવેશ", "കണ്ടെത്തിയില്ല", "ലഭ്യമല്ല", "അനുമതി", "സെർവർ", "ശ്രമിക്കുക", "ക്ഷമിക്കണം", "പിശക്", "ಕಂಡುಬಂದಿಲ್ಲ", "ಲಭ್ಯವಿಲ್ಲ",
    "ಸರ್ವರ್", "ಪ್ರಯತ್ನಿಸಿ", "ಕ್ಷಮಿಸಿ", "ದೋಷ", "ಅನುಮತಿ", "ମିଳିଲା ନାହିଁ", "ଉପଲବ୍ଧ", "ସର୍ଭର", "ଚେଷ୍ଟା", "କ୍ଷମା", "ତ୍ରୁଟି", "ଅନୁମତି",
)


def _finder(parts: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in parts:
        out.add_word(p, p)
    out.make_automaton()
    return out


_FILLER_FINDER, _MESSAGE_FINDER = _finder(_FILLER_PARTS), _finder(_MESSAGE_PARTS)


def _holds(finder: ahocorasick.Automaton, text: str) -> bool:
    # The rules, which ignore case, take these two letters for i and s; lower() does not.
    return next(finder.iter(text.replace("İ", "i").replace("ſ", "s").lower()), None) is not None


def _may_have_filler(text: str) -> bool:
    return _holds(_FILLER_FINDER, text) or len(_SHORT_LATIN.findall(text)) > 3


def has_field(text: str) -> bool:
    """An unfilled field, or what is printed for a missing value, that is not quoted or spoken of."""
    signs, printed = bool(_FIELD_SIGN.search(text)), any(x in text for x in _MISSING_PARTS)
    if not signs and not printed:
        return False
    bare = QUOTED.sub(" ", text)
    # Quotation marks belong to some fields ({% include 'x' %}); those are looked for in the text itself, outside of code marks.
    if signs and (FIELDS.search(bare) or ("__" in bare and _LONG_UNDERSCORED.search(bare)) or ("{%" in text and regex.search(r"(?<!`)\{%-?\s*\w[^%{}`\n]*%\}(?!`)", text))):
        return True
    return printed and bool(MISSING.search(_SPOKEN.sub(" ", bare)))


def has_filler(text: str) -> bool:
    """Filler that is not quoted."""
    return _may_have_filler(text) and bool(FILLERS.search(QUOTED.sub(" ", text)))


def is_message(text: str) -> bool:
    """Nothing but messages, a menu and one short sentence at most."""
    messages, others = 0, 0
    for part in _SENTENCE.split(_MENU_INSIDE.sub("\n", text) if "|" in text else text):
        part = part.strip()
        n = len(_WORD.findall(part))
        if not n or _MENU.match(part):
            continue
        if _holds(_MESSAGE_FINDER, part) and MESSAGES.search(part):
            messages += 1
        else:
            others += 1
            if others > 1 or n > SHORT_SENTENCE:
                return False
    return messages > 0


def residue_kind(text: str | None) -> str | None:
    """field, filler or message; None for content, null, empty and blank texts."""
    if not text or not text.strip():
        return None
    if has_field(text):
        return "field"
    if has_filler(text):
        return "filler"
    return "message" if is_message(text) else None


def residue(frame: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of (key, kind) of the texts that hold residue. Repeated rows each come out; null texts never do."""
    out = T.StructType([T.StructField("key", frame.schema[key].dataType), T.StructField("kind", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [residue_kind(x) for x in batch.column("text").to_pylist()]
            take = [i for i, k in enumerate(kinds) if k]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(take, pa.int64())), pa.array([kinds[i] for i in take], pa.string())], out.names)

    return frame.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out).withColumnRenamed("key", key)
