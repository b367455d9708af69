"""Added tokens: literals found in raw text, leftmost and longest first.

As a regular expression this is one alternation with longer literals first; the same
pattern serves Python and the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.spec import AddedToken


class AddedTokens:
    def __init__(self, tokens: list[AddedToken]):
        self.tokens = [t for t in tokens if t.content]
        self.by_content = {t.content: t.id for t in self.tokens}
        self.by_id = {t.id: t.content for t in self.tokens}
        self.special_ids = {t.id for t in self.tokens if t.special}
        ordered = sorted(self.by_content, key=lambda c: (-len(c), c))
        self.pattern = "|".join(map(re.escape, ordered))
        self._find = re.compile(f"({self.pattern})") if ordered else None

    def __len__(self) -> int:
        return len(self.by_id)

    def split(self, text: str) -> list[str | int]:
        """Texts and token ids in order; no empty texts."""
        if not text:
            return []
        if self._find is None:
            return [text]
        return [self.by_content[p] if i % 2 else p for i, p in enumerate(self._find.split(text)) if p]

    def java_pattern(self) -> str:
        return "|".join("\\Q" + c.replace("\\E", "\\E\\\\E\\Q") + "\\E" for c in sorted(self.by_content, key=lambda c: (-len(c), c)))

    def split_column(self, c: Column) -> Column:
        """array<struct<text, token_id>>; one of the two is null in each element."""
        seg = "array<struct<text:string,token_id:int>>"
        if self._find is None:
            only = F.array(F.struct(c.alias("text"), F.lit(None).cast("int").alias("token_id")))
            return F.when(c == "", F.array().cast(seg)).when(c.isNotNull(), only)
        p = F.lit(self.java_pattern())
        ids = F.create_map(*[x for k, v in self.by_content.items() for x in (F.lit(k), F.lit(v))])
        gaps, found = F.split(c, self.java_pattern(), -1), F.regexp_extract_all(c, p, F.lit(0))
        pairs = F.arrays_zip(gaps.alias("g"), found.alias("m"))
        none = F.lit(None)
        both = F.flatten(F.transform(pairs, lambda z: F.array(F.struct(z["g"].alias("text"), none.cast("int").alias("token_id")), F.struct(none.cast("string").alias("text"), F.element_at(ids, z["m"]).alias("token_id")))))
        return F.filter(both, lambda x: (x["text"] != "") | x["token_id"].isNotNull())
