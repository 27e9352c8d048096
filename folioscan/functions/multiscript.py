"""Normal form of text in any script. Spark has neither NFKC nor case folding, so this is an Arrow function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Digits that are read for letters in printed labels.
LOOKALIKE = str.maketrans({"0": "o", "1": "i"})


def normal(text: str) -> str:
    """NFKC and folded case, & as a word, no apostrophes; letters, numbers and combining marks, single blanks."""
    folded = re.sub("['’`]", "", unicodedata.normalize("NFKC", text).casefold().replace("&", " and "))
    if folded.isascii():
        return " ".join(re.sub("[^a-z0-9]", " ", folded).split())
    return " ".join("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in folded).split())


def as_label(text: str) -> str:
    return normal(text).translate(LOOKALIKE)


@F.pandas_udf(StringType())
def normal_of(texts: pd.Series) -> pd.Series:
    return texts.map(normal, na_action="ignore")


def label_of(c: Column) -> Column:
    """Normal form for comparing with labels."""
    return F.translate(normal_of(c), "01", "oi")


#: Words of each gender on job cards.
GENDERS = {
    "TRANSGENDER": ["T", "TG", "TRANSGENDER", "THIRD GENDER", "किन्नर", "ट्रांसजेंडर", "তৃতীয় লিঙ্গ", "ట్రాన్స్ జెండర్", "திருநங்கை"],
    "FEMALE": ["F", "FEMALE", "WOMAN", "महिला", "स्त्री", "मादा", "মহিলা", "নারী", "ಹೆಣ್ಣು", "స్త్రీ", "பெண்"],
    "MALE": ["M", "MALE", "MAN", "पुरुष", "नर", "পুরুষ", "ಪುರುಷ", "పురుషుడు", "ஆண்"],
}
#: Yes and no.
YES = ["yes", "y", "true", "1", "हाँ", "हां", "জি", "হ্যাঁ", "అవును", "ஆம்"]
NO = ["no", "n", "false", "0", "नहीं", "नही", "না", "కాదు", "இல்லை"]


def gender(c: Column) -> Column:
    """A gender whose word the whole text is."""
    return F.coalesce(*[F.when(normal_of(c).isin([normal(w) for w in words]), kind) for kind, words in GENDERS.items()])


def category(c: Column) -> Column:
    """Social category; other texts as printed, blank ones null."""
    letters = F.regexp_replace(F.upper(normal_of(c)), "[^A-Z]", "")
    return (
        F.when(letters.isin("SC", "SCHEDULEDCASTE") | c.contains("अनुसूचित जाति"), "SC")
        .when(letters.isin("ST", "SCHEDULEDTRIBE") | c.contains("अनुसूचित जनजाति"), "ST")
        .when(letters.isin("OBC", "OTHERBACKWARDCLASS") | c.contains("अन्य पिछड़ा वर्ग"), "OBC")
        .when(letters.isin("OTHER", "OTHERS", "GENERAL", "GEN"), "OTHER")
        .when(F.trim(c) != "", F.trim(c))
    )


def yes_no(c: Column) -> Column:
    value = normal_of(c)
    return F.when(value.isin([normal(w) for w in YES]) | value.rlike(r"\byes\b"), True).when(value.isin([normal(w) for w in NO]) | value.rlike(r"\bno\b"), False)
