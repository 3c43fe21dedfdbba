"""Secrets out of messages.

What is masked: passwords in addresses, tokens of messaging services, arguments of mail protocols' commands, values of
settings whose name says that they are secret, HTTP credentials, base64 that stands alone, mail addresses, incomes.

A rule is a plain pattern without look-around, so other engines can run it too, and the text that it needs to find
anything: texts without it skip the pattern. Where a pattern alone can't decide, a first rule puts a mark, later ones
take marks away again, and a last one masks what is still marked.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import let

MASK = "[masked]"
# Names of settings whose values are secrets; names that are so only before "=".
SECRET_NAMES = ["access_token", "api-key", "api_key", "apikey", "authorization", "client_secret", "mot de passe", "motdepasse", "pass", "passwd", "password", "pwd", "secret", "signature", "token", "topic"]
AMBIGUOUS_NAMES = ["auth", "key", "session", "sig"]
# Words after a command's name that show that it is talked about, not given: grammar, outcomes, nouns of
# protocols, in English and French.
TALK = [
    "a", "an", "and", "are", "at", "by", "for", "from", "has", "in", "is", "must", "not", "of", "on", "or", "the", "to", "was", "with",
    "au", "aux", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "ne", "non", "ou", "par", "pas", "pour", "sans", "sur", "un", "une",
    "aborted", "accepted", "completed", "denied", "disabled", "error", "expected", "expired", "failed", "failure", "forbidden", "ignored", "invalid", "issued", "missing", "ok", "rejected", "required", "timeout", "unknown", "unsupported",
    "accepté", "attendu", "échec", "échoué", "erreur", "expiré", "ignoré", "impossible", "inconnu", "inconnue", "incorrect", "incorrecte", "interdit", "invalide", "manquant", "manquante", "refus", "refusé", "refusée", "rejeté", "requis", "requise",
    "argument", "authentication", "capability", "command", "commande", "mechanism", "mécanisme", "méthode", "method", "parameter", "paramètre", "phase", "server", "serveur", "state", "syntax", "syntaxe",
]
#: Marks of a place: what follows is no value; what is between a pair may be one.
QUIET, PAIR = "\x01", "\x02"

#: A value in quotes, or up to what ends one, with a letter or digit in it.
_IN_VALUE = "[^\\s\"'&,;()\\[\\]{}" + QUIET + PAIR + "]"
VALUE = f"(?:\"[^\"\\n]*\"|'[^'\\n]*'|{_IN_VALUE}*[A-Za-z0-9]{_IN_VALUE}*)"
BLANKS = "[ \\t]+"
#: Words that are followed by no other letter; accents are letters.
_TALK = f"((?i:{'|'.join(TALK)})(?:[^A-Za-z0-9À-ÿ]|\\z))"
_MECHANISM = "[A-Z0-9][A-Z0-9_-]*"
#: What stands before a line's answer in traces of mail protocols.
_TRACE = "(?:[A-Z]+ ?(?:->|<-|=>|<=) ?[A-Z]+: ?|[CS]: ?|[<>+] ?)?"
#: A service's address up to a path: its host, and a port perhaps.
_PORT = "(?::[0-9]{1,5})?"


def named(words: list[str]) -> str:
    """A setting's name with one of words among its parts. Parts stand apart by digits or . _ -, or begin with a capital
    after a small letter (a name in capitals alone has no such humps)."""
    longest = sorted(words, key=len, reverse=True)
    plain, humps = "|".join(map(re.escape, longest)).replace("\\ ", " "), "|".join(w.capitalize() for w in longest if w.isalpha())
    before = "(?:[A-Za-z0-9._-]*[0-9._-])?"
    after = "(?:[0-9._-][A-Za-z0-9._-]*|(?-i:[A-Z][a-z0-9]+[A-Za-z0-9._-]*))?"
    return f"\\b(?:{before}(?:{plain})|(?-i:[A-Za-z0-9._-]*[a-z0-9](?:{humps}))){after}"


#: (texts of which one must occur, in lower case; pattern; replacement).
RULES = [
    (["://"], "(://)[^\\s/@:]*:[^\\s/@]*(@)", "$1" + MASK + "$2"),
    # bot addresses: the path begins with "bot" and the token, or with "file/bot" and the token
    (["api.telegram.org"], f"(?i)(\\bapi\\.telegram\\.org{_PORT}/(?:file/)?bot)[^\\s/?#]+", "$1" + MASK),
    # bot tokens: the bot's number, a colon, letters, digits, _ and -
    ([":"], "(^|[^A-Za-z0-9])[0-9]{5,20}:[A-Za-z0-9_-]{32,64}", "$1" + MASK),
    # topics are the first part of a path: letters, digits, _ and -
    (["ntfy."], f"(?i)(\\bntfy\\.[a-z0-9][a-z0-9.-]*{_PORT}/)[a-z0-9_-]+", "$1" + MASK),
    (["login", "pass", "auth"], f"\\b(LOGIN|PASS|AUTH|AUTHENTICATE)({BLANKS}){_TALK}", f"$1{QUIET}$2$3"),
    (["auth"], f"\\b(AUTH(?:ENTICATE)?{BLANKS}{_MECHANISM})({BLANKS}){_TALK}", f"$1{QUIET}$2$3"),
    (["auth"], f"\\b(AUTH(?:ENTICATE)?{BLANKS}{_MECHANISM}{BLANKS}){VALUE}", "$1" + MASK),
    (["login"], f"\\b(LOGIN{BLANKS}){VALUE}{BLANKS}{VALUE}", "$1" + MASK),
    (["pass"], f"\\b(PASS{BLANKS}){VALUE}", "$1" + MASK),
    # an address is no secret: what is secret in it has a name of its own
    (["://"], "([:=]>?\\s*)([a-zA-Z][a-zA-Z0-9+.-]*://)", f"$1{QUIET}$2"),
    (SECRET_NAMES, f"(?i)({named(SECRET_NAMES)}[\"']?\\s*(?:=>|[:=])\\s*)(?:(?:bearer|basic)\\s+)?{VALUE}", "$1" + MASK),
    (["="], f"(?i)({named(AMBIGUOUS_NAMES)}[\"']?\\s*=>?\\s*){VALUE}", "$1" + MASK),
    ([QUIET], QUIET, ""),
    (["bearer", "basic"], "(?i)\\b(bearer|basic)(\\s+)[a-z0-9._~+/=-]{8,}", "$1$2" + MASK),
    (["="], "\\b[A-Za-z0-9+/]{20,}={1,2}([^A-Za-z0-9=]|\\z)", MASK + "$1"),
    # base64 without padding is all of a line, four letters at a time, small ones and capitals
    ([], f"(?m)^({_TRACE})((?:[A-Za-z0-9+/]{{4}}){{4,}})(\\r?)$", f"$1{PAIR}$2{PAIR}$3"),
    ([PAIR], f"{PAIR}([^a-z{PAIR}]*|[^A-Z{PAIR}]*){PAIR}", "$1"),
    ([PAIR], f"{PAIR}[^{PAIR}]*{PAIR}", MASK),
    (["@"], "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}", MASK),
    (["rfr", "fisca"], "(?i)\\b((?:[a-z0-9]+_)*rfr(?:[ _.-]{0,2}[a-z0-9]{1,8}){0,3}|revenus? fisca(?:l|ux)[a-zé ]{0,32})(\\s*[:=]\\s*)[0-9]+(?:[., \\x{A0}\\x{202F}][0-9]+)*", "$1$2" + MASK),
]


def _applied(needs: list[str], pattern: str, replacement: str):
    pattern = pattern.replace("(?m)", "(?dm)")  # lines end with \n alone
    letters = any(c.isalpha() for n in needs for c in n)

    def masked(m: Column) -> Column:
        done = F.regexp_replace(m, pattern, replacement)
        if not needs:
            return done
        return F.when(m.rlike("(?i)" + "|".join(map(re.escape, needs))) if letters else m.contains(needs[0]), done).otherwise(m)

    return masked


def redact(message: Column, literals: list[str] | None = None) -> Column:
    """message without the literals (of four characters or more, longest first) and without what the rules find."""
    for literal in sorted((x for x in literals or [] if len(x.strip()) >= 4), key=len, reverse=True):
        message = F.replace(message, F.lit(literal), F.lit(MASK))
    for rule in RULES:
        message = let(message, _applied(*rule))
    return message


def redact_sql(column: str) -> str:
    """:func:`redact` without literals as a SQL expression of DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for _, pattern, replacement in RULES:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(re.sub('[$]([0-9])', r'\\\1', replacement))}, 'g')"
    return column
