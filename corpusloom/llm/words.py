"""Words as the matching operators see them: without case, punctuation, markup, white space or invisible characters."""

from __future__ import annotations

import re
import unicodedata

#: Characters that are never seen: soft hyphen, zero width, direction marks, joiners, BOM, tags.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
HAN = "㐀-䶿一-鿿豈-﫿"
#: A Han character alone, or letters and digits with dots, hyphens, underscores between them (names of settings, dates).
WORD = re.compile(rf"[{HAN}]|[^\W_{HAN}]+(?:['’._\-]+[^\W_{HAN}]+)*")


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return WORD.findall(TAG.sub(" ", text).casefold())
