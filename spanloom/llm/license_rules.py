"""Signatures of licences, as text. Patterns are Java regular expressions over text with A to Z in lower case."""

from __future__ import annotations

# Keywords: every match holds all the words of one of the alternatives (set apart by /), whatever stands between them.
# Label | keyword | the licence's name | its SPDX identifiers.
LICENCES = r"""
mit | mit/expat | (?:mit|expat)[\s-]+licen[cs]e|licen[cs]ed\s+under\s+mit | mit
mit-0 | mit | mit[\s-]+no[\s-]+attribution | mit-0
x11 | x11 | x11[\s-]+licen[cs]e | x11
isc | isc | isc[\s-]+licen[cs]e | isc
apache | apache | apache(?:\s+software)?[\s-]+licen[cs]e | apache-(?:1\.[01]|2\.0)
apache-2.0 | apache | apache(?:\s+software)?[\s-]+licen[cs]e,?\s+(?:version|v\.?)?\s*2(?:\.0)? | apache-2\.0
apache-1.1 | apache | apache(?:\s+software)?[\s-]+licen[cs]e,?\s+(?:version|v\.?)?\s*1\.1 | apache-1\.1
gpl | general public | (?:gnu\s+)?general\s+public\s+licen[cs]e | gpl-[123]\.0(?:-only|-or-later)?\+?
gpl-1.0 | general public | (?:gnu\s+)?general\s+public\s+licen[cs]e,?\s+(?:version|v\.?)?\s*1(?:\.0)? | gpl-1\.0(?:-only|-or-later)?\+?
gpl-2.0 | general public | (?:gnu\s+)?general\s+public\s+licen[cs]e,?\s+(?:version|v\.?)?\s*2(?:\.0)? | gpl-2\.0(?:-only|-or-later)?\+?
gpl-3.0 | general public | (?:gnu\s+)?general\s+public\s+licen[cs]e,?\s+(?:version|v\.?)?\s*3(?:\.0)? | gpl-3\.0(?:-only|-or-later)?\+?
lgpl | general public | (?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[cs]e | lgpl-[23]\.[01](?:-only|-or-later)?\+?
lgpl-2.1 | general public | (?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e,?\s+(?:version|v\.?)?\s*2\.1 | lgpl-2\.1(?:-only|-or-later)?\+?
lgpl-3.0 | general public | (?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e,?\s+(?:version|v\.?)?\s*3(?:\.0)? | lgpl-3\.0(?:-only|-or-later)?\+?
agpl | affero | (?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e | agpl-[13]\.0(?:-only|-or-later)?\+?
agpl-3.0 | affero | (?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e,?\s+(?:version|v\.?)?\s*3(?:\.0)? | agpl-3\.0(?:-only|-or-later)?\+?
gfdl | free documentation | (?:gnu\s+)?free\s+documentation\s+licen[cs]e | gfdl-1\.[123](?:-only|-or-later)?
mpl | mozilla | mozilla\s+public\s+licen[cs]e | mpl-[12]\.[01]
mpl-2.0 | mozilla | mozilla\s+public\s+licen[cs]e,?\s+(?:version|v\.?)?\s*2(?:\.0)? | mpl-2\.0
epl | eclipse | eclipse\s+public\s+licen[cs]e | epl-[12]\.0
epl-2.0 | eclipse | eclipse\s+public\s+licen[cs]e,?\s+(?:-\s*)?(?:version|v\.?)?\s*2(?:\.0)? | epl-2\.0
edl | eclipse | eclipse\s+distribution\s+licen[cs]e | edl-1\.0
bsd | bsd | bsd(?:[\s-]+style)?[\s-]+licen[cs]e | bsd-[0-9a-z-]+
bsd-2-clause | bsd | (?:simplified|freebsd|2[\s-]+clause|two[\s-]+clause)\s+bsd|bsd[\s-]+2[\s-]+clause | bsd-2-clause
bsd-3-clause | bsd | (?:new|modified|revised|3[\s-]+clause|three[\s-]+clause)\s+bsd|bsd[\s-]+3[\s-]+clause | bsd-3-clause
bsd-4-clause | bsd | (?:original|4[\s-]+clause|four[\s-]+clause)\s+bsd|bsd[\s-]+4[\s-]+clause | bsd-4-clause
0bsd | bsd | (?:zero[\s-]+clause|0[\s-]+clause)\s+bsd|bsd[\s-]+zero[\s-]+clause | 0bsd
creative-commons | creative commons | creative\s+commons(?:\s+licen[cs]e)? | cc-[a-z0-9.-]+
cc-by | cc by | cc[\s-]+by(?![\s-]+(?:nc|nd|sa)) | cc-by-[1234]\.[05]
cc-by-sa | cc by | cc[\s-]+by[\s-]+sa | cc-by-sa-[1234]\.[05]
cc-by-nc | cc by | cc[\s-]+by[\s-]+nc(?![\s-]+(?:nd|sa)) | cc-by-nc-[1234]\.[05]
cc-by-nd | cc by | cc[\s-]+by[\s-]+nd | cc-by-nd-[1234]\.[05]
cc-by-nc-sa | cc by | cc[\s-]+by[\s-]+nc[\s-]+sa | cc-by-nc-sa-[1234]\.[05]
cc-by-nc-nd | cc by | cc[\s-]+by[\s-]+nc[\s-]+nd | cc-by-nc-nd-[1234]\.[05]
cc-by | creative commons | creative\s+commons\s+attribution(?![\s-]+(?:non|no|share)) | cc-by
cc-by-sa | creative commons | creative\s+commons\s+attribution[\s-]+share[\s-]*alike | cc-by-sa
cc-by-nc | creative commons | creative\s+commons\s+attribution[\s-]+non[\s-]*commercial(?![\s-]+(?:no|share)) | cc-by-nc
cc-by-nd | creative commons | creative\s+commons\s+attribution[\s-]+no[\s-]*deriv(?:ative)?s? | cc-by-nd
cc0 | cc0 | cc0(?:\s+1\.0)?(?:\s+universal)? | cc0-1\.0
unlicense | unlicen | (?:the\s+)?unlicen[cs]e | unlicense
wtfpl | wtfpl/what public | wtfpl|do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+licen[cs]e | wtfpl
zlib | zlib | zlib(?:/libpng)?[\s-]+licen[cs]e | zlib
libpng | libpng | libpng[\s-]+licen[cs]e | libpng(?:-2\.0)?
boost | boost | boost\s+software\s+licen[cs]e | bsl-1\.0
artistic | artistic | (?:perl\s+)?artistic\s+licen[cs]e | artistic-[12]\.0(?:-perl|-cl8)?
perl | perl | same\s+terms\s+as\s+perl(?:\s+itself)? | artistic-1\.0-perl
python | python/psf | (?:python|psf)(?:\s+software\s+foundation)?\s+licen[cs]e | (?:psf|python)-2\.0(?:\.1)?
ruby | ruby | ruby(?:'s)?\s+licen[cs]e | ruby
php | php | php\s+licen[cs]e | php-3\.0?1?
postgresql | postgresql | postgresql\s+licen[cs]e | postgresql
openssl | openssl | openssl\s+licen[cs]e | openssl
curl | curl | curl\s+licen[cs]e | curl
ofl | open font | (?:sil\s+)?open\s+font\s+licen[cs]e | ofl-1\.[01]
eupl | european union | european\s+union\s+public\s+licen[cs]e | eupl-1\.[012]
cecill | cecill | cecill(?:-[bc])?(?:\s+licen[cs]e)? | cecill-[0-9bc.]+
cddl | common development | common\s+development\s+and\s+distribution\s+licen[cs]e | cddl-1\.[01]
cpl | common public | common\s+public\s+licen[cs]e | cpl-1\.0
ms-pl | microsoft | microsoft\s+public\s+licen[cs]e | ms-pl
ms-rl | microsoft | microsoft\s+reciprocal\s+licen[cs]e | ms-rl
osl | open software | open\s+software\s+licen[cs]e | osl-[123]\.[01]
afl | academic free | academic\s+free\s+licen[cs]e | afl-[123]\.[012]
ncsa | ncsa | (?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?\s+licen[cs]e | ncsa
w3c | w3c | w3c(?:\s+software)?(?:\s+notice\s+and)?\s+licen[cs]e | w3c
unicode | unicode | unicode\s+(?:terms\s+of\s+use|licen[cs]e) | unicode-(?:dfs-201[56]|3\.0)
icu | icu | icu\s+licen[cs]e | icu
odbl | open database | (?:odc\s+)?open\s+database\s+licen[cs]e | odbl-1\.0
odc-by | open data commons | open\s+data\s+commons\s+attribution | odc-by-1\.0
pddl | open data commons | open\s+data\s+commons\s+public\s+domain | pddl-1\.0
cdla | community agreement/cdla | community\s+data\s+licen[cs]e\s+agreement|cdla\s+data\s+agreement | cdla-(?:permissive|sharing)-[12]\.0
elastic | elastic | elastic\s+licen[cs]e | elastic-2\.0
sspl | server side | server\s+side\s+public\s+licen[cs]e | sspl-1\.0
bsl | business source | business\s+source\s+licen[cs]e | busl-1\.1
commons-clause | commons clause | commons\s+clause | commons-clause
llama | llama | llama\s*[0-9.]*\s+community\s+licen[cs]e | llama[0-9.]+
openrail | openrail | (?:big(?:science|code)\s+)?openrail(?:-[ms]+)?(?:\s+licen[cs]e)? | openrail
json | json | json\s+licen[cs]e | json
beerware | beer | beer[\s-]*ware(?:\s+licen[cs]e)? | beerware
vim | vim | vim\s+licen[cs]e | vim
tex | latex | latex\s+project\s+public\s+licen[cs]e | lppl-1\.[0-3]c?
qpl | q public | q\s+public\s+licen[cs]e | qpl-1\.0
sleepycat | sleepycat | sleepycat\s+licen[cs]e | sleepycat
""".strip()

# Label | keyword | pattern of a notice that names no licence.
NOTICES = r"""
all-rights-reserved | rights reserved | all\s+rights\s+reserved
public-domain | public domain | (?:released|dedicated|placed|put)?\s*(?:in|into|to)\s+the\s+public\s+domain
mit | permission hereby | permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining
isc | permission use | permission\s+to\s+use,?\s+copy,?\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software
bsd | redistribution use | redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms
warranty-disclaimer | provided/distributed/licensed | (?:provided|distributed|licensed)\s+(?:on\s+an\s+)?["']?as[\s-]+is["']?
non-commercial | commercial | (?:for\s+)?non[\s-]?commercial\s+(?:use|purposes)(?:\s+only)?
proprietary | proprietary | proprietary\s+(?:and|&)\s+confidential|proprietary\s+licen[cs]e
mit | permission notice | the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included
mit | merge sublicen | merge,?\s+publish,?\s+distribute,?\s+sublicen[cs]e,?\s+and/or\s+sell
isc | provided notice | provided\s+that\s+the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+appear\s+in\s+all\s+copies
bsd | redistributions source | redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright
bsd | redistributions binary | redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright
bsd-3-clause | endorse promote | to\s+endorse\s+or\s+promote\s+products\s+derived\s+from\s+this\s+software\s+without\s+specific\s+prior\s+written\s+permission
bsd-4-clause | advertising mentioning | all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software
x11 | advertising otherwise | shall\s+not\s+be\s+used\s+in\s+advertising\s+or\s+otherwise\s+to\s+promote\s+the\s+sale
apache-2.0 | licenses license-2.0 | (?:https?://)?www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
apache-2.0 | except compliance | you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+licen[cs]e
apache-2.0 | perpetual royalty | perpetual,?\s+worldwide,?\s+non-exclusive,?\s+no-charge,?\s+royalty-free,?\s+irrevocable\s+(?:copyright|patent)\s+licen[cs]e
apache | contributor agreements | foundation\s+\(asf\)\s+under\s+one\s+or\s+more\s+contributor\s+licen[cs]e\s+agreements
gpl | redistribute modify | you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu
gpl | distributed hope | distributed\s+in\s+the\s+hope\s+that\s+it\s+will\s+be\s+useful,?\s+but\s+without\s+any\s+warranty
gpl | gnu.org licenses | (?:https?://)?www\.gnu\.org/licenses/(?:old-licenses/)?gpl(?:-[123]\.0)?
lgpl | gnu.org licenses | (?:https?://)?www\.gnu\.org/licenses/(?:old-licenses/)?lgpl(?:-[23]\.[01])?
agpl | gnu.org licenses | (?:https?://)?www\.gnu\.org/licenses/agpl(?:-3\.0)?
gpl | verbatim document | everyone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+copies\s+of\s+this\s+licen[cs]e\s+document
gfdl | invariant sections | with\s+no\s+invariant\s+sections,?\s+no\s+front-cover\s+texts
mpl-2.0 | mozilla subject | this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+licen[cs]e
boost | license_1_0 | (?:https?://)?www\.boost\.org/license_1_0\.txt
boost | accompanying documentation | obtaining\s+a\s+copy\s+of\s+the\s+software\s+and\s+accompanying\s+documentation\s+covered\s+by\s+this\s+licen[cs]e
zlib | altered plainly | altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked
zlib | misrepresented origin | the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented
unlicense | unencumbered domain | free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain
unlicense | unlicense.org | (?:https?://)?(?:www\.)?unlicense\.org
cc0 | waives neighboring/waives neighbouring | waives\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights
cc-by | creativecommons.org licenses | (?:https?://)?creativecommons\.org/licenses/by/[1-4]\.[05]
cc-by-sa | creativecommons.org licenses | (?:https?://)?creativecommons\.org/licenses/by-sa/[1-4]\.[05]
cc-by-nc | creativecommons.org licenses | (?:https?://)?creativecommons\.org/licenses/by-nc/[1-4]\.[05]
cc0 | creativecommons.org publicdomain | (?:https?://)?creativecommons\.org/publicdomain/zero/1\.0
ofl | reserved font | with\s+reserved\s+font\s+name
warranty-disclaimer | merchantability fitness | merchantability,?\s+fitness\s+for\s+a\s+particular\s+purpose
liability-disclaimer | event liable | in\s+no\s+event\s+shall\s+the\s+(?:authors|copyright\s+(?:owner|holders?))(?:\s+or\s+(?:copyright\s+holders|contributors))?\s+be\s+liable
trade-secret | trade secrets | (?:contains|constitutes?)\s+(?:confidential\s+)?trade\s+secrets
evaluation-only | evaluation license/evaluation licence | evaluation\s+licen[cs]e|licen[cs]e\s+for\s+evaluation\s+purposes\s+only
academic-only | academic license/academic licence | academic(?:\s+use)?\s+licen[cs]e
copyright-notice | copyright | copyright\s*(?:\(c\)|©)?\s*(?:19|20)\d\d
""".strip()

# Words of which every match of a rule holds one; texts without any go by unread.
GATES = ("licen", "spdx", "bsd", "cc", "perl", "unicode", "wtfpl", "cecill", "beer", "openrail", "commons", "cdla", "mit", "reserved", "domain", "permission", "redistribution", "provided", "distributed", "commercial", "proprietary", "copyright", "advertising", "endorse", "redistribute", "invariant", "altered", "misrepresented", "waives", "merchantability", "liable", "secrets", "boost.org")


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(number, label, keyword, pattern, priority, confidence), in order.

    Each licence gives an SPDX tag, a grant ("licensed under ..."), and a mention of its name. A longer name contains a
    shorter one's match and so suppresses it at equal priority.
    """
    apart = r"(?<![a-z0-9]){}(?![a-z0-9])"
    grant = r"(?:licen[cs]ed|released|distributed|available|provided|published|used|covered)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:{})(?:\s+licen[cs]e)?"
    licences = [[x.strip() for x in line.split(" | ")] for line in LICENCES.splitlines()]
    # of tags that match the same characters the first counts, so families come behind their versions
    out = [(label, "spdx-license-identifier", rf"spdx-license-identifier:\s*(?:{ids})(?![a-z0-9.+-])", 3, 0.99) for label, _, _, ids in reversed(licences)]
    for label, keyword, name, _ in licences:
        out.append((label, keyword, apart.format(grant.format(name)), 2, 0.95))
        out.append((label, keyword, apart.format(f"(?:{name})"), 1, 0.8))
    for line in NOTICES.splitlines():
        label, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, keyword, apart.format(f"(?:{pattern})"), 0, 0.5))
    return [(i, *x) for i, x in enumerate(out)]
