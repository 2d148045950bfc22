"""Known licence texts in the forms that they usually have, from the files in spdx/.

`ids.txt` is the SPDX list's identifiers; every other file is the full text of the licence that
it is named after.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterable, Iterator
from pathlib import Path

FOLDER = Path(__file__).parent / "spdx"

#: Title lines under which short texts stand, besides none.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "(MIT License)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "The ISC License (ISC)", "ISC License (ISC)", "ISC License (ISCL)", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Revised BSD License", "Modified BSD License", "BSD License", "The BSD License", "BSD-3-Clause"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng license"],
    "BSL-1.0": [],
    "Unlicense": ["The Unlicense", "Unlicense"],
}

#: Names by which notices call a licence.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0"],
    **{f"GPL-{v}.0": [f"GNU General Public License, version {v}", f"GNU General Public License v{v}.0", f"GNU General Public License version {v}.0", f"GNU GPL v{v}", f"GNU GPLv{v}", f"GPLv{v}", f"GPL-{v}.0", f"GPL-{v}.0 License"] for v in (2, 3)},
    **{f"LGPL-{v}": [f"GNU Lesser General Public License, version {v}", f"GNU Lesser General Public License v{v}", f"LGPLv{v}", f"LGPL-{v}", f"LGPL-{v} License"] for v in ("2.1", "3.0")},
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPLv3", "AGPLv3", "AGPL-3.0", "AGPL-3.0 License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPL-2.0 License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["Unlicense"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    **{
        f"CC-{short}-{v}": [f"CC {short} {v}", f"CC-{short}-{v}", f"Creative Commons {long} {v}{' International' * (v == '4.0')} License", f"Creative Commons {long} {v}{' International' * (v == '4.0')}", f"Creative Commons {long} {v} License", f"Creative Commons {long} {v}"]
        for short, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
        for v in ("2.0", "2.5", "3.0", "4.0")
    },
}
_LEADS = ["Licensed under", "Released under", "Distributed under", "Available under", *(f"This {what} is {how} under" for what in ("project", "work", "software", "program", "library", "file") for how in ("licensed", "released", "distributed"))]

#: Where a text ends for those who leave out how to apply it.
_APPENDIX = re.compile(r"\n[ \t]*(?:APPENDIX: How to apply|Appendix: How to Apply These|How to Apply These Terms|ADDENDUM: How to use this License|Exhibit A - Source Code Form)")
_END = re.compile(r"\n[ \t]*END OF TERMS AND CONDITIONS[ \t]*\n?")
_ADDRESS = re.compile(r"\n[ \t]*51 Franklin St[^\n]*")


def ids() -> list[str]:
    return (FOLDER / "ids.txt").read_text().split()


def texts() -> dict[str, str]:
    """Full text by licence."""
    return {p.name.removesuffix(".txt"): p.read_text() for p in sorted(FOLDER.glob("*.txt")) if p.name != "ids.txt"}


def _bodies(text: str) -> Iterator[str]:
    """text with and without its appendix, the line before it, and the Free Software Foundation's address."""
    ends = [text]
    if m := _APPENDIX.search(text):
        ends.append(text[: m.start()])
        if e := _END.search(text):
            ends.append(text[: e.start()])
    for body in ends:
        yield body
        if _ADDRESS.search(body):
            yield _ADDRESS.sub("", body, count=1)
            yield _ADDRESS.sub("\n 59 Temple Place, Suite 330, Boston, MA  02111-1307  USA", body, count=1)


def _wrapped(text: str, short: bool) -> Iterator[str]:
    """text as it stands, with a paragraph a line, and, where short, at usual widths: lines that begin with Copyright go."""
    yield text
    parts = re.split(r"\n[ \t]*\n", text)
    for width in (10**6, *(range(66, 83) if short else ())):
        yield "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in parts)


def variants(license: str, text: str) -> Iterator[str]:
    """The usual forms of a licence's full text."""
    short = license in TITLES
    for body in _bodies(text):
        lines = body.strip("\n").split("\n")
        bare = "\n".join(lines[1:]) if short and lines[0].strip() in TITLES[license] else "\n".join(lines)
        for form in _wrapped(bare, short):
            for title in ["", *TITLES.get(license, [])]:
                for rights in ["", "All rights reserved."] if short else [""]:
                    yield "\n\n".join(x for x in (title, rights, form) if x)


def notices() -> Iterator[tuple[str, str]]:
    for license, names in NAMES.items():
        for name in names:
            for lead in _LEADS:
                for article in ("", "the "):
                    yield license, f"{lead} {article}{name}."
    for i in ids():
        yield i, f"SPDX-License-Identifier: {i}"


def expanded(stated: list[tuple[str, str]], same) -> list[tuple[str, str]]:
    """stated, then the usual forms of its texts and of those in spdx/, notices and SPDX lines; same gives what makes two forms one."""
    seen: set[str] = set()

    def new(found: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
        return [(name, text) for name, text in found if (key := same(text)) and not (key in seen or seen.add(key))]

    whole = [*((name, text) for name, text in stated if "\n" in text), *texts().items()]
    return new(stated) + new((name, form) for name, text in whole for form in variants(name, text)) + new(notices())
