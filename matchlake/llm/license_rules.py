"""License signatures: a table of licenses and sentence forms, combined into ordered regex rules.

Rules read normalised text: lower-case words joined by single spaces, so
``Apache License, Version 2.0`` reads ``apache license version 2 0``.
"""

from __future__ import annotations

from typing import NamedTuple

# label; words of which each must stand in whatever the pattern matches (one of those joined by /); pattern of the license's name.
LICENSES = [
    line.split(" | ")
    for line in r"""
mit | mit/expat license/licence | (?:the )?(?:mit|expat)(?: x11)? licen[sc]e
mit-0 | mit 0/attribution | mit 0|mit no attribution
apache-1.1 | apache | (?:the )?apache(?: software)? licen[sc]e(?: version)? 1 1
apache-2.0 | apache | (?:the )?apache(?: software)? licen[sc]e(?: v| version)? ?2(?: 0)?
bsd-2-clause | bsd | (?:the )?(?:2 clause|two clause|simplified) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?
bsd-3-clause | bsd | (?:the )?(?:3 clause|three clause|new|modified|revised) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?
bsd-4-clause | bsd | (?:the )?(?:4 clause|four clause|original) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?
0bsd | 0bsd/bsd | (?:the )?(?:0bsd|zero clause bsd)(?: licen[sc]e)?
gpl-1.0 | general license/licence | (?:the )?(?:gnu )?general public licen[sc]e (?:v|version) ?1
gpl-2.0 | general license/licence | (?:the )?(?:gnu )?general public licen[sc]e (?:v|version) ?2
gpl-3.0 | general license/licence | (?:the )?(?:gnu )?general public licen[sc]e (?:v|version) ?3
gpl-2.0-short | gpl/gplv/gplv2/gpl2 | (?:the )?(?:gnu )?gpl ?v?(?: version )?2(?: 0)?
gpl-3.0-short | gpl/gplv/gplv3/gpl3 | (?:the )?(?:gnu )?gpl ?v?(?: version )?3(?: 0)?
lgpl-2.0 | library | (?:the )?(?:gnu )?library general public licen[sc]e
lgpl-2.1 | lesser | (?:the )?(?:gnu )?lesser general public licen[sc]e (?:v|version) ?2 1
lgpl-3.0 | lesser | (?:the )?(?:gnu )?lesser general public licen[sc]e (?:v|version) ?3
lgpl-short | lgpl/lgplv2/lgpl2/lgplv3/lgpl3 | (?:the )?(?:gnu )?lgpl(?: ?v?(?:2 1|3))?
agpl-3.0 | affero | (?:the )?(?:gnu )?affero general public licen[sc]e(?: (?:v|version) ?3)?
agpl-short | agpl/agplv3/agpl3 | (?:the )?(?:gnu )?agpl(?: ?v?3)?
gfdl-1.2 | documentation | (?:the )?(?:gnu )?free documentation licen[sc]e (?:v|version) ?1 2
gfdl-1.3 | documentation | (?:the )?(?:gnu )?free documentation licen[sc]e(?: (?:v|version) ?1 3)?
mpl-1.1 | mozilla | (?:the )?mozilla public licen[sc]e (?:v|version) ?1 1
mpl-2.0 | mozilla | (?:the )?mozilla public licen[sc]e(?: (?:v|version) ?2(?: 0)?)?
mpl-short | mpl/mpl1/mpl2/mplv1/mplv2 | (?:the )?mpl ?v?(?:1 1|2 0)
epl-1.0 | eclipse | (?:the )?eclipse public licen[sc]e(?: v| version)? ?1 0
epl-2.0 | eclipse | (?:the )?eclipse public licen[sc]e(?: v| version)? ?2 0
edl-1.0 | eclipse | (?:the )?eclipse distribution licen[sc]e
cddl-1.0 | cddl/cddl1/cddlv1 | (?:the )?cddl(?: ?v?1 0)?
cddl-1.0-name | distribution | (?:the )?common development and distribution licen[sc]e
cpl-1.0 | common license/licence | (?:the )?common public licen[sc]e
cpal-1.0 | attribution | (?:the )?common public attribution licen[sc]e
eupl-1.1 | eupl/eupl1/euplv1 | (?:the )?(?:european union public licen[sc]e )?eupl ?v?1 1
eupl-1.2 | eupl/eupl1/euplv1 | (?:the )?(?:european union public licen[sc]e )?eupl(?: ?v?1 2)?
eupl-name | european | (?:the )?european union public licen[sc]e
artistic-1.0 | artistic | (?:the )?artistic licen[sc]e(?: v| version)? ?1 0
artistic-2.0 | artistic | (?:the )?artistic licen[sc]e(?: (?:v|version)? ?2 0)?
isc | isc | (?:the )?isc licen[sc]e
zlib | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
libpng | libpng/png license/licence | (?:the )?(?:png reference library|libpng) licen[sc]e
boost-1.0 | boost | (?:the )?boost software licen[sc]e(?: (?:v|version)? ?1 0)?
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | (?:the )?wtfpl
beerware | beerware | (?:the )?beerware licen[sc]e
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by-2.0 | cc | cc by 2 0
cc-by-3.0 | cc | cc by 3 0
cc-by-4.0 | cc | cc by 4 0
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-name | creative | (?:a |the )?creative commons attribution(?: (?:[234] 0 )?(?:international|unported|generic))?(?: licen[sc]e)?
cc-by-sa-name | creative | (?:a |the )?creative commons attribution share ?alike(?: [234] 0)?
cc-by-nc-name | creative | (?:a |the )?creative commons attribution non ?commercial(?: [234] 0)?
cc-by-nd-name | creative | (?:a |the )?creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [234] 0)?
cc-zero-name | creative | creative commons zero
public-domain | domain public | (?:the )?public domain
psf-2.0 | python/psf license/licence | (?:the )?(?:python software foundation|psf) licen[sc]e
python-2.0 | python | (?:the )?python licen[sc]e
php-3.01 | php | (?:the )?php licen[sc]e(?: (?:v|version)? ?3 01)?
ruby | ruby | (?:the )?ruby licen[sc]e
perl | perl terms | (?:the )?same terms as perl(?: itself)?
ofl-1.1 | font | (?:the )?(?:sil )?open font licen[sc]e(?: (?:v|version)? ?1 1)?
odbl-1.0 | database | (?:the )?open (?:data commons open )?database licen[sc]e
odc-by-1.0 | odc | (?:the )?odc by(?: 1 0)?
odc-pddl | pddl | (?:the )?pddl(?: 1 0)?
ms-pl | microsoft | (?:the )?microsoft public licen[sc]e
ms-rl | microsoft | (?:the )?microsoft reciprocal licen[sc]e
osl-3.0 | open license/licence | (?:the )?open software licen[sc]e(?: (?:v|version)? ?3 0)?
afl-3.0 | academic | (?:the )?academic free licen[sc]e(?: (?:v|version)? ?3 0)?
ecl-2.0 | educational | (?:the )?educational community licen[sc]e
ncsa | illinois/ncsa | (?:the )?(?:university of illinois|ncsa)(?: open source)? licen[sc]e
openssl | openssl | (?:the )?openssl licen[sc]e
postgresql | postgresql | (?:the )?postgresql licen[sc]e
qpl-1.0 | qpl | (?:the )?qpl(?: 1 0)?
sleepycat | sleepycat | (?:the )?sleepycat licen[sc]e
upl-1.0 | universal | (?:the )?universal permissive licen[sc]e
vim | vim | (?:the )?vim licen[sc]e
w3c | w3c | (?:the )?w3c(?: software)?(?: notice)?(?: and)? licen[sc]e
zpl-2.1 | zope | (?:the )?zope public licen[sc]e
busl-1.1 | business license/licence | (?:the )?business source licen[sc]e
sspl-1.0 | server license/licence | (?:the )?server side public licen[sc]e
elastic-2.0 | elastic | (?:the )?elastic licen[sc]e
proprietary | rights reserved | all rights reserved
""".strip().splitlines()
]

# priority; words around the name, in normalised text; how sure a match is.
FORMS = [
    (1, r"spdx license identifier {name}", 1.0),
    (2, r"(?:is |are )?(?:dual )?licen[sc]ed under (?:the terms of )?{name}", 0.95),
    (3, r"(?:released|distributed|published|provided|shared|made available|available) under (?:the terms of )?{name}", 0.9),
    (4, r"(?:subject to|governed by|covered by|in accordance with|terms of|under) {name}", 0.8),
    (5, r"{name}", 0.5),
]


class Rule(NamedTuple):
    priority: int
    label: str
    keywords: tuple[tuple[str, ...], ...]
    pattern: str
    score: float


def rules() -> list[Rule]:
    """Every license in every sentence form, surest form first; matches begin and end at word bounds."""
    return [
        Rule(priority, label, tuple(tuple(k.split("/")) for k in keywords.split(" ")), r"(?<= )" + form.format(name=f"(?:{name})") + r"(?= )", score)
        for priority, form, score in FORMS
        for label, keywords, name in LICENSES
    ]
