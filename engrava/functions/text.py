"""Text expressions: tokens, trigrams, classifiers, labels. All are built-in functions, so they stay in the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

# What the classifiers look for.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]{1,}|[0-9]{3,}"
IDENTIFIER = [r'"[^"]{4,}"', r"\b(?=\w*[A-Za-z])(?=\w*\d)\w+\b", r"\b\w+_\w+\b", r"\b[a-z]+[A-Z]\w*\b", r"\b[A-Z]{5,}\b", r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b", r"\b[A-Za-z_]\w*/[A-Za-z_]\w\S*"]
ESTIMATE = ["approximately", "roughly", "about", "around", "probably", "i think", "seems?", "i(?:'d)? guess", "more or less"]
HYPOTHESIS = ["maybe", "might be", "could be that", "i suspect", "what if", "could be", "possibly", "perhaps"]
OPINION = ["i prefer", "i like", "better", "worse", "i'?d rather", "i love", "in my opinion"]
FACT = ["confirmed", "measured", "verified", "definitely", "turns out", "in fact", "the fact is"]
VERBATIM = [r'"[^"]+"', "«[^»]+»", r"(?i)\b(?:verbatim|exact|quote|quoted|said|wrote)\b", r"(?i)\bday\s+\d+\b", "(?i)^найди дословно", "(?i)^точная цитата", "(?i)^что я сказал", "(?i)^что я писал"]
HISTORICAL = ["original", "originally", "before", "first", "initial", "initially", "earlier", "previously", "previous"]
HISTORICAL_RU = [r"оригинал|оригинальн\w*", "сначала", r"изначальн\w*", "ранее"]
CORRECTION_CUE = ["remind me", "what'?s the correct", "how do we"]
CORRECTION_CUE_RU = [r"\bвспомни(?:ть)?\b", r"\bнапомни(?:ть)?\b\s*(?:мне\s*[,:]?\s*)?(?:как\s+мы\s+|правильн\w*)", r"\bкакой\s+правильн\w*\b", r"\bне\s+так[,]?\s+а\s+вот\s+так\b", r"\bна\s+самом\s+деле\b"]
CORRECTION = [r"no,\s*actually", r"that'?s\s+wrong"]
CORRECTION_RU = [r"нет,\s*правильно", r"вспомни(?:ть)?\s+правильн\w*", r"не\s+так[,]?\s+а\s+вот\s+так", r"на\s+самом\s+деле"]
NOISE_STARTS = ["<command-message>", "<command-name>", "<command-args>", "<local-command-caveat>", "<local-command-stdout>", "<local-command-stderr>", "Base directory for this skill:", "<task-notification>", "<system-reminder>", "Below is one record from a developer"]
NOISE_IS = ["[Request interrupted by user]"]
SIGNALS = ["forget", "override", "ignore previous", "you are now", "from now on", "system:", "admin:", "instruction:", "disregard", "new instructions", "ignore previous instructions"]
WEAK_SIGNALS = ["different", "instead", "actually", "update"]
SIGNALS_BY_LANGUAGE = {
    "ru": ["забудь", "забыть", "игнорируй", "отмени", "сбрось", "новые инструкции", "теперь ты", "с этого момента"],
    "ja": ["忘れて", "無視", "リセット", "新しい指示", "これから", "今から"],
    "ar": ["انسى", "تجاهل", "إعادة تعيين", "تعليمات جديدة", "أنت الآن"],
    "de": ["vergiss", "ignoriere", "überschreibe", "neue anweisungen", "ab jetzt"],
    "fr": ["oublie", "ignore", "remplace", "nouvelles instructions"],
    "es": ["olvida", "ignora", "sobrescribe", "nuevas instrucciones"],
    "zh": ["忘记", "忽略", "重置", "新指令", "从现在开始"],
}
NO_ANCHOR = """the this that these those there here when what which with from then have been will would should could about after before into
over under other another some such than them they your please thanks using request users desktop library applications downloads home
task-notification task-id tool-use-id output-file session-id record-id caveat local-command-stdout local-command-caveat command-name
command-message system-reminder они это этот эта эти этого этой этом этих если когда чтобы чтоб потому поэтому также теперь что как для или
оно она его нее неё все всё вот так уже еще ещё был была было были быть есть нет при под над без про после перед через между потом тоже
только очень надо нужно можно кто где куда зачем почему пока сейчас того тогда здесь там даже меня тебя себя него итог итоги стадия одно
один одна два две три результат результаты дальше состояние живой лучшая лучший важная важный хочешь хочу серия вопрос ответ правки готово
план шаг шаги true false none null code phase wave step note next done test tests fixed ready чего чему чем кого кому кем ком тому этому
этим мне мной тебе тобой нам нами вам вами ней ним ними себе собой весь вся всей всех всем всеми по-прежнему во-первых во-вторых
в-третьих что-нибудь кто-нибудь как-нибудь где-нибудь""".split()
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _any_word(words: list[str], flags: str = "i") -> str:
    """Any of the words; the flag U lets letters of every script count as such."""
    return rf"(?{flags})\b(?:" + "|".join(words) + r")\b"


#: Marks camel boundaries while a text is tokenised; no text has it.
_SEAM = "\u0001"
_TOKEN_WITH_SEAMS = rf"[A-Za-z_][A-Za-z0-9_{_SEAM}]*[A-Za-z0-9_]|[0-9]{{3,}}"


def tokens(text: Column) -> Column:
    """Identifiers of two or more characters and numbers of three or more, lower-cased, each followed by its snake and
    camel parts (of three or more characters, if there are several).

    Camel boundaries are marked in the whole text at once, so that only tokens with parts are looked at again.
    """
    long = lambda a: F.filter(a, lambda p: F.length(p) > 2)
    none = F.array().cast("array<string>")

    def parts(raw: Column) -> Column:
        whole = F.array(F.replace(F.lower(raw), F.lit(_SEAM), F.lit("")))
        several = lambda mark, drop: F.when(raw.contains(mark), F.transform(F.array(long(F.split(F.replace(F.lower(raw), F.lit(drop), F.lit("")), mark))), lambda p: F.when(F.size(p) > 1, p).otherwise(none))[0]).otherwise(none)
        return F.when(raw.contains("_") | raw.contains(_SEAM), F.concat(whole, several("_", _SEAM), several(_SEAM, "\u0002"))).otherwise(whole)

    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", f"$1{_SEAM}$2"), "([A-Z])([A-Z][a-z])", f"$1{_SEAM}$2")
    return F.flatten(F.transform(F.regexp_extract_all(marked, F.lit(_TOKEN_WITH_SEAMS), F.lit(0)), parts))


def trigrams(text: Column) -> Column:
    """Distinct substrings of three characters, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two lower-cased texts; 0 if either is shorter than three characters."""
    x, y = trigrams(F.lower(a)), trigrams(F.lower(b))
    shared = F.size(F.array_intersect(x, y))
    return shared / F.greatest(F.size(x) + F.size(y) - shared, F.lit(1))  # no branch, so each part is computed once


def contains_cue(text: Column, cue: str) -> Column:
    return F.lit(len(cue) >= 4) & F.lower(text).contains(cue.lower())


def identifier_shaped(text: Column) -> Column:
    return reduce(lambda x, y: x | y, [text.rlike(p) for p in IDENTIFIER])


def epistemic_status(text: Column) -> Column:
    """estimate, hypothesis, opinion or fact - the first whose markers occur in the first 2,000 characters."""
    head = F.substring(text, 1, 2000)
    hit = lambda words: head.rlike(_any_word(words))
    return F.when(text.isNull() | head.rlike(r"^\s*$"), "unknown").when(hit(ESTIMATE) | head.rlike(r"~\s?\d"), "estimate").when(hit(HYPOTHESIS), "hypothesis").when(hit(OPINION), "opinion").when(hit(FACT), "fact").otherwise("unknown")


def salience(directive: Column, entity_tags: Column, epistemic: Column) -> Column:
    n = lambda c, w: F.when(c, w).otherwise(0.0)
    score = n(directive, 1.0) + n(epistemic == "fact", 1.0) + n(F.size(entity_tags) > 0, 0.5)
    return F.when(score >= 1.0, "notable").otherwise("unflagged")


def is_noise(text: Column) -> Column:
    return reduce(lambda x, y: x | y, [text.startswith(p) for p in NOISE_STARTS] + [text == p for p in NOISE_IS])


def is_correction(text: Column) -> Column:
    return text.rlike(_any_word(CORRECTION)) | text.rlike(_any_word(CORRECTION_RU, "iU"))


def cue_mode(text: Column) -> Column:
    return F.when(reduce(lambda x, y: x | y, [text.rlike(p) for p in VERBATIM]), "verbatim").otherwise("concept")


def cue_intent(text: Column) -> Column:
    """historical_verbatim for cues that ask for earlier wording, unless they ask for the correct state."""
    asks = text.rlike(_any_word(CORRECTION_CUE)) | text.rlike("(?iU)" + "|".join(CORRECTION_CUE_RU))
    return F.when(~asks & (text.rlike(_any_word(HISTORICAL)) | text.rlike(_any_word(HISTORICAL_RU, "iU"))), "historical_verbatim")


def injection(text: Column, language: Column | None = None) -> Column:
    """(detected, severity, confidence, matched): instruction-like phrases, those of the text's language included."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    strong = hits(SIGNALS)
    if language is not None:
        more = reduce(lambda acc, x: acc.when(language == x[0], hits(x[1])), SIGNALS_BY_LANGUAGE.items(), F.when(F.lit(False), F.array().cast("array<string>")))
        strong = F.concat(strong, F.coalesce(more, F.array().cast("array<string>")))
    weak = hits(WEAK_SIGNALS)
    return F.struct((F.size(strong) + F.size(weak) > 0).alias("detected"), F.when(F.size(strong) > 0, "strong").when(F.size(weak) > 0, "weak").otherwise("none").alias("severity"), F.when(F.size(strong) > 0, 0.9).when(F.size(weak) > 0, 0.6).otherwise(0.0).alias("confidence"), F.concat(strong, weak).alias("matched"))


def shield_action(verdict: Column, tier: str) -> Column:
    """What is done with a text that ``injection`` judged, by the tier of the place it goes to: reject, flag or log_allow."""
    return F.when(~verdict["detected"], "log_allow").otherwise({"hard_block": "reject", "flag": "flag"}.get(tier, "log_allow"))


def entity_anchors(text: Column, most: int = 16) -> Column:
    """Names that a text can be found by: in backticks, handles, joined identifiers, camel case, capitalised inside a
    sentence; lower-cased, 3 to 40 characters, no common words, in order of kind and place."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 12000)
    pick = lambda p: F.regexp_extract_all(head, F.lit(p), F.lit(1))
    found = F.concat(
        F.filter(pick(r"`([^`\n]{2,60})`"), lambda x: ~F.trim(x).contains(" ")),
        pick(r"(?U)(?<!\w)@([A-Za-z0-9_]{3,32})"),
        pick(r"(?U)(?<![\w./-])([A-Za-zЀ-ӿ][A-Za-z0-9Ѐ-ӿ]*(?:[._-][A-Za-z0-9Ѐ-ӿ]+)+)(?![\w/-])"),
        pick(r"(?U)(?<!\w)([a-z]+[A-Z][A-Za-z]+|[A-Z][a-z]+(?:[A-Z][a-z]+)+)(?!\w)"),
        pick(r"(?<=[^\s.!?…]\s)(?<![A-Za-zЀ-ӿ])([A-ZА-ЯЁ][a-zа-яё]{2,})(?![A-Za-zЀ-ӿ])"),
    )
    clean = F.transform(found, lambda x: F.substring_index(F.lower(F.regexp_replace(x, r"^[ \t\r\n.,;:!?()\[\]{}\"'«»]+|[ \t\r\n.,;:!?()\[\]{}\"'«»]+$", "")), "/", -1))
    particle = r"^[а-яёѐ-ӿ]{1,6}-[а-яёѐ-ӿ]{1,6}$"
    good = F.filter(clean, lambda x: F.length(x).between(3, 40) & x.rlike(r"^[a-z0-9Ѐ-ӿ._'\-]+$") & x.rlike("[a-zЀ-ӿ]") & ~x.rlike(particle) & ~x.isin(NO_ANCHOR))
    return F.slice(F.array_distinct(good), 1, most)


def anchor_overlap(cue_tokens: list[str], anchors: Column) -> Column:
    """Share of the cue's tokens that an anchor answers: equal, or one starts the other, with a stem of five letters
    or more and three more at most."""
    if not cue_tokens:
        return F.lit(0.0)

    def answered(t: str) -> Column:
        close = lambda a: ((F.startswith(a, F.lit(t)) & (len(t) >= 5)) | (F.startswith(F.lit(t), a) & (F.length(a) >= 5))) & (F.abs(F.length(a) - len(t)) <= 3)
        return F.exists(anchors, lambda a: (a == t) | close(a)).cast("int")

    return F.coalesce(reduce(lambda x, y: x + y, map(answered, cue_tokens)) / len(cue_tokens), F.lit(0.0))


def index_parts(index: Column, mark: str) -> Column:
    """Segments of an index text like E:alpha/beta T:x/y that follow a mark."""
    body = F.regexp_extract(F.coalesce(index, F.lit("")), rf"(?:^|\s){mark}:(\S+)", 1)
    return F.filter(F.split(F.lower(body), "/"), lambda x: x != "")


def gain(profile: Column, keys: list[str]) -> Column:
    """Product of the gains that a MAP<STRING, DOUBLE> has for the keys; 1 for absent ones."""
    return reduce(lambda x, y: x * y, [F.coalesce(F.try_element_at(profile, F.lit(k)), F.lit(1.0)) for k in keys], F.lit(1.0))


def age_label(age_seconds: Column) -> Column:
    """One coarse unit: 45m, 3h, 12d, 5w, 8mo, 2y; empty for the future."""
    s = age_seconds.cast("double")
    days = s / 86400
    unit = lambda v, u: F.concat(F.floor(v).cast("string"), F.lit(u))
    return F.when(s < 0, "").when(s < 3600, unit(F.greatest(F.lit(1.0), s / 60), "m")).when(s < 48 * 3600, unit(s / 3600, "h")).when(days < 14, unit(days, "d")).when(days < 63, unit(days / 7, "w")).when(days / 30.44 < 18, unit(days / 30.44, "mo")).otherwise(F.concat(F.rint(days / 365.25).cast("long").cast("string"), F.lit("y")))


def age_penalty(age_days: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), age_days / 30.0))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def tools_trailer(names: Column) -> Column:
    """The names a reply used, distinct, eight at most and how many more."""
    seen = F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))
    more = F.when(F.size(seen) > 8, F.concat(F.lit(" +"), (F.size(seen) - 8).cast("string"))).otherwise("")
    return F.when(F.size(seen) > 0, F.concat(F.lit("\n[tools: "), F.array_join(F.slice(seen, 1, 8), ", "), more, F.lit("]"))).otherwise("")


def tools_of(text: Column) -> Column:
    body = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"\n\[tools: ([^\]]+)\]\z", 1), r" \+\d+$", "")
    return F.filter(F.transform(F.split(body, ", "), lambda x: F.trim(x)), lambda x: x != "")


def scrub_secrets(text: Column, mark: str = "[redacted]") -> Column:
    """Each line with a secret-shaped token (key prefixes, private-key heads, key = long value) is replaced whole."""
    shaped = r"(?im)^.*(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?:password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S{8,}).*$"
    return F.regexp_replace(text, shaped, mark)


@dataclass(frozen=True)
class DateMention:
    year: int | None = None
    month: int | None = None
    day: int | None = None


def date_mentions(cue: str) -> list[DateMention]:
    """Dates a cue names: YYYY-MM[-DD], or month names with day or year; a bare May, March or abbreviation is none."""
    out: list[DateMention] = []
    ok = lambda v, lo, hi: v if v is not None and lo <= v <= hi else None
    for y, m, d in re.findall(r"\b(\d{4})-(\d{2})(?:-(\d{2}))?\b", cue or ""):
        if ok(int(y), 1900, 2200) and ok(int(m), 1, 12) and (not d or ok(int(d), 1, 31)):
            out.append(DateMention(int(y), int(m), int(d) if d else None))
    names = "|".join([*MONTHS, "sept", *[m[:3] for m in MONTHS if m != "may"]])
    for m in re.finditer(rf"(?i)\b(?:(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?)?({names})\.?(?:\s+(\d{{1,2}})(?:st|nd|rd|th)?)?(?:,?\s+(\d{{4}}))?\b", cue or ""):
        word = m[2].lower()
        month = next(i for i, x in enumerate(MONTHS, 1) if x.startswith(word[:3]))
        day, year = ok(int(m[1] or m[3] or 0), 1, 31), ok(int(m[4] or 0), 1900, 2200)
        if day is None and year is None and (word in ("may", "march") or word not in MONTHS):
            continue
        out.append(DateMention(year, month, day))
    return list(dict.fromkeys(out))


def matches_dates(at: Column, mentions: list[DateMention]) -> Column:
    """True where some mention's named parts all equal those of the time."""
    tests = [reduce(lambda x, y: x & y, [f(at) == v for f, v in ((F.year, m.year), (F.month, m.month), (F.dayofmonth, m.day)) if v is not None]) for m in mentions if m != DateMention()]
    return F.coalesce(reduce(lambda x, y: x | y, tests), F.lit(False)) if tests else F.lit(False)
