"""Patient pseudonyms."""

from pyspark.sql import Column, functions as F


def pseudonym(name: Column, birth_date: Column, salt: str) -> Column:
    def strip(c):
        # Blanks of all alphabets and the separators U+001C to U+001F.
        return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    text = F.concat_ws("|", F.lower(strip(name)), strip(birth_date), F.lit(salt))
    return F.concat(F.lit("ANON-"), F.upper(F.substring(F.sha2(text, 256), 1, 12)))
