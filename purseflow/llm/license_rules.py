"""Signature rules of the license scan: hand-written regexes with keyword, priority and confidence.

All regexes are Java regexes over text with A-Z in lower case, and every match of a rule contains
one of GATES and the rule's keyword, which are looked for first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Between words of a name; before and after it no letter or digit may stand.
_GAP = r"[\s,;:\"'()*#/-]{1,4}"
_LEFT, _RIGHT = r"(?<![a-z0-9])", r"(?![a-z0-9])"
_VERSION = rf"(?:{_GAP})?(?:v|ver|version)?\.?\s?"
_LATER = r"(?:\s?(?:\+|or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+version)?))?"

# What any rule needs; texts with none of these are not looked at further.
GATES = ("licen", "spdx", "gpl", "creative commons", "creativecommons.org", "cc-by", "cc by", "cc0",
         "public domain", "wtfpl", "all rights reserved", "copyleft", "opensource.org", "gnu.org",
         "mozilla.org/", "sil.org/", "mariadb.com/", "latex-project.org/", "w3.org/consortium")

# label: (keyword, name, identifier, address). Versions are told apart by the rows of a family.
_LICENSES = {
    "0bsd": ("bsd", r"(?:zero[- ]clause|0[- ]clause) bsd(?: licen[sc]e)", r"0bsd", r"opensource\.org/licenses?/0bsd"),
    "afl-3.0": ("academic", r"academic free licen[sc]e@3(?:\.0)?", r"afl-3\.0", r"opensource\.org/licenses?/afl-3\.0"),
    "agpl-3.0": ("affero", r"(?:gnu )?affero general public licen[sc]e@3(?:\.0)?+", r"agpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl-3\.0"),
    "agpl": ("affero", r"(?:gnu )?affero general public licen[sc]e", r"agpl", r"gnu\.org/licenses/agpl"),
    "apache-1.0": ("apache", r"apache(?: software)? licen[sc]e@1\.0", r"apache-1\.0", r"apache\.org/licenses/license-1\.0"),
    "apache-1.1": ("apache", r"apache(?: software)? licen[sc]e@1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    "apache-2.0": ("apache", r"apache(?: software)? licen[sc]e@2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    "artistic-1.0": ("artistic", r"artistic licen[sc]e@1(?:\.0)?", r"artistic-1\.0", r"opensource\.org/licenses?/artistic-1\.0"),
    "artistic-2.0": ("artistic", r"artistic licen[sc]e@2(?:\.0)?", r"artistic-2\.0", r"opensource\.org/licenses?/artistic-2\.0"),
    "blueoak-1.0.0": ("blue oak", r"blue oak model licen[sc]e(?: 1\.0\.0)?", r"blueoak-1\.0\.0", r"blueoakcouncil\.org/license/1\.0\.0"),
    "bsd-2-clause": ("bsd", r"(?:2|two)[- ]clause bsd(?: licen[sc]e)|(?:simplified|freebsd) bsd licen[sc]e|bsd (?:2|two)[- ]clause(?: licen[sc]e)", r"bsd-2-clause(?:-patent)?", r"opensource\.org/licenses?/bsd-2-clause"),
    "bsd-3-clause": ("bsd", r"(?:3|three)[- ]clause bsd(?: licen[sc]e)|(?:new|modified|revised) bsd licen[sc]e|bsd (?:3|three)[- ]clause(?: licen[sc]e)", r"bsd-3-clause(?:-clear)?", r"opensource\.org/licenses?/bsd-3-clause"),
    "bsd-4-clause": ("bsd", r"(?:4|four)[- ]clause bsd(?: licen[sc]e)|original bsd licen[sc]e", r"bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    "bsd": ("bsd", r"bsd(?:[- ]style)? licen[sc]e", r"bsd", r"opensource\.org/licenses?/bsd-license"),
    "bsl-1.0": ("boost", r"boost software licen[sc]e@1(?:\.0)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    "busl-1.1": ("business", r"business source licen[sc]e@1\.1", r"busl-1\.1", r"mariadb\.com/bsl11"),
    "cc0-1.0": ("cc0", r"cc0(?:@1\.0)?(?: universal)?(?: public domain dedication)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    "cddl-1.0": ("common development", r"common development and distribution licen[sc]e@1(?:\.0)?", r"cddl-1\.0", r"opensource\.org/licenses?/cddl-1\.0"),
    "cddl-1.1": ("common development", r"common development and distribution licen[sc]e@1\.1", r"cddl-1\.1", r"spdx\.org/licenses/cddl-1\.1"),
    "cecill-2.1": ("cecill", r"cecill free software licen[sc]e(?: agreement)?@2\.1", r"cecill-2\.1", r"opensource\.org/licenses?/cecill-2\.1"),
    "cpl-1.0": ("common public", r"common public licen[sc]e@1(?:\.0)?", r"cpl-1\.0", r"opensource\.org/licenses?/cpl1\.0"),
    "ecl-2.0": ("educational", r"educational community licen[sc]e@2(?:\.0)?", r"ecl-2\.0", r"opensource\.org/licenses?/ecl-2\.0"),
    "epl-1.0": ("eclipse", r"eclipse public licen[sc]e@1(?:\.0)?", r"epl-1\.0", r"opensource\.org/licenses?/epl-1\.0"),
    "epl-2.0": ("eclipse", r"eclipse public licen[sc]e@2(?:\.0)?", r"epl-2\.0", r"opensource\.org/licenses?/epl-2\.0"),
    "eupl-1.1": ("european", r"european union public licen[sc]e@1\.1", r"eupl-1\.1", r"opensource\.org/licenses?/eupl-1\.1"),
    "eupl-1.2": ("european", r"european union public licen[sc]e@1\.2", r"eupl-1\.2", r"opensource\.org/licenses?/eupl-1\.2"),
    "gfdl-1.2": ("documentation", r"gnu free documentation licen[sc]e@1\.2+", r"gfdl-1\.2(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    "gfdl-1.3": ("documentation", r"gnu free documentation licen[sc]e@1\.3+", r"gfdl-1\.3(?:-only|-or-later)?", r"gnu\.org/licenses/fdl-1\.3"),
    "gpl-1.0": ("gpl", r"gpl@1(?:\.0)?+", r"gpl-1\.0(?:-only|-or-later)?\+?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    "gpl-2.0": ("gpl", r"gpl@2(?:\.0)?+", r"gpl-2\.0(?:-only|-or-later)?\+?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    "gpl-3.0": ("gpl", r"gpl@3(?:\.0)?+", r"gpl-3\.0(?:-only|-or-later)?\+?", r"gnu\.org/licenses/gpl-3\.0"),
    "gpl-1.0 ": ("general public", r"(?:gnu )?general public licen[sc]e@1(?:\.0)?+", r"gpl-1\.0-classpath", r"gnu\.org/copyleft/gpl-1"),
    "gpl-2.0 ": ("general public", r"(?:gnu )?general public licen[sc]e@2(?:\.0)?+", r"gpl-2\.0-with-classpath-exception", r"gnu\.org/copyleft/gpl-2"),
    "gpl-3.0 ": ("general public", r"(?:gnu )?general public licen[sc]e@3(?:\.0)?+", r"gpl-3\.0-with-gcc-exception", r"gnu\.org/copyleft/gpl-3"),
    "gpl": ("general public", r"gnu general public licen[sc]e", r"gpl", r"gnu\.org/(?:licenses|copyleft)/gpl\.(?:html|txt)"),
    "hpnd": ("historical", r"historical permission notice and disclaimer(?: licen[sc]e)", r"hpnd", r"opensource\.org/licenses?/hpnd"),
    "isc": ("isc", r"isc licen[sc]e", r"isc", r"opensource\.org/licenses?/isc"),
    "lgpl-2.0": ("library general", r"(?:gnu )?library general public licen[sc]e@2(?:\.0)?+", r"lgpl-2\.0(?:-only|-or-later)?\+?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    "lgpl-2.1": ("lesser", r"(?:gnu )?lesser general public licen[sc]e@2\.1+", r"lgpl-2\.1(?:-only|-or-later)?\+?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    "lgpl-3.0": ("lesser", r"(?:gnu )?lesser general public licen[sc]e@3(?:\.0)?+", r"lgpl-3\.0(?:-only|-or-later)?\+?", r"gnu\.org/licenses/lgpl-3\.0"),
    "lgpl": ("lesser", r"(?:gnu )?lesser general public licen[sc]e", r"lgpl", r"gnu\.org/(?:licenses|copyleft)/lgpl\.(?:html|txt)"),
    "libpng": ("libpng", r"libpng licen[sc]e", r"libpng(?:-2\.0)?", r"libpng\.org/pub/png/src/libpng-license"),
    "lppl-1.3c": ("latex", r"latex project public licen[sc]e@1\.3c?", r"lppl-1\.3c", r"latex-project\.org/lppl/lppl-1-3c"),
    "mit-0": ("attribution", r"mit no attribution(?: licen[sc]e)", r"mit-0", r"opensource\.org/licenses?/mit-0"),
    "mit": ("mit", r"mit licen[sc]e|expat licen[sc]e|licen[sc]e:? mit", r"mit", r"opensource\.org/licenses?/mit(?:-license(?:\.php)?)?"),
    "mpl-1.1": ("mozilla", r"mozilla public licen[sc]e@1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/mpl-1\.1"),
    "mpl-2.0": ("mozilla", r"mozilla public licen[sc]e@2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    "ms-pl": ("microsoft", r"microsoft public licen[sc]e", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    "ms-rl": ("microsoft", r"microsoft reciprocal licen[sc]e", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
    "ncsa": ("illinois", r"university of illinois/?\s?ncsa open source licen[sc]e", r"ncsa", r"opensource\.org/licenses?/ncsa"),
    "odbl-1.0": ("database", r"open (?:data commons open )?database licen[sc]e(?:@1(?:\.0)?)?", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "odc-by-1.0": ("data commons", r"open data commons attribution licen[sc]e(?:@1(?:\.0)?)?", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    "pddl-1.0": ("public domain", r"public domain dedication and licen[sc]e(?:@1(?:\.0)?)?", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    "ofl-1.1": ("open font", r"(?:sil )?open font licen[sc]e@1\.1", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    "openssl": ("openssl", r"openssl licen[sc]e", r"openssl", r"openssl\.org/source/license"),
    "osl-3.0": ("open software", r"open software licen[sc]e@3(?:\.0)?", r"osl-3\.0", r"opensource\.org/licenses?/osl-3\.0"),
    "php-3.01": ("php", r"php licen[sc]e@3\.01", r"php-3\.01", r"php\.net/license/3_01"),
    "postgresql": ("postgresql", r"postgresql licen[sc]e", r"postgresql", r"opensource\.org/licenses?/postgresql"),
    "psf-2.0": ("python", r"python(?: software foundation)? licen[sc]e(?:@2(?:\.0)?)?", r"(?:psf|python)-2\.0", r"docs\.python\.org/3/license"),
    "qpl-1.0": ("q public", r"q public licen[sc]e(?:@1(?:\.0)?)?", r"qpl-1\.0", r"opensource\.org/licenses?/qpl-1\.0"),
    "ruby": ("ruby", r"ruby licen[sc]e", r"ruby", r"ruby-lang\.org/en/about/license"),
    "sspl-1.0": ("server side", r"server side public licen[sc]e(?:@1(?:\.0)?)?", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    "unicode": ("unicode", r"unicode(?:, inc\.)? licen[sc]e(?: agreement)?", r"unicode-(?:dfs-2016|3\.0)", r"unicode\.org/license"),
    "unlicense": ("unlicense", r"the unlicense", r"unlicense", r"unlicense\.org"),
    "upl-1.0": ("universal", r"universal permissive licen[sc]e(?:@1(?:\.0)?)?", r"upl-1\.0", r"opensource\.org/licenses?/upl"),
    "vim": ("vim", r"vim licen[sc]e", r"vim", r"vimhelp\.org/uganda\.txt\.html#license"),
    "w3c": ("w3c", r"w3c software(?: notice and| and document)? licen[sc]e", r"w3c(?:-20150513)?", r"w3\.org/consortium/legal/2015/copyright-software"),
    "wtfpl": ("wtfpl", r"wtfpl", r"wtfpl", r"wtfpl\.net"),
    "x11": ("x11", r"x11 licen[sc]e", r"x11", r"spdx\.org/licenses/x11"),
    "zlib": ("zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib", r"opensource\.org/licenses?/zlib"),
    "zpl-2.1": ("zope", r"zope public licen[sc]e@2\.1", r"zpl-2\.1", r"spdx\.org/licenses/zpl-2\.1"),
    "public-domain": ("public domain", r"(?:in|into|to) the public domain", r"licenseref-public-domain", r"creativecommons\.org/publicdomain/mark/1\.0"),
    "proprietary": ("rights", r"all rights reserved", r"licenseref-proprietary", r"licenseref-all-rights-reserved"),
}

# Creative Commons: element codes with their words; each in every version, or without one.
_CC_ELEMENTS = {
    "by": "attribution",
    "by-sa": "attribution[- ]share[- ]?alike",
    "by-nd": "attribution[- ]no[- ]?deriv(?:ative)?s",
    "by-nc": "attribution[- ]non[- ]?commercial",
    "by-nc-sa": "attribution[- ]non[- ]?commercial[- ]share[- ]?alike",
    "by-nc-nd": "attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s",
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0", "")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float


def _forms(label: str, keyword: str, name: str, identifier: str, address: str) -> list[Rule]:
    """Tag, grant, address and bare name of one license, from the surest to the least sure."""
    name = name.replace("@", _VERSION).replace("?+", "?" + _LATER)
    name = name[:-1] + _LATER if name.endswith("+") and name[-2].isdigit() else name
    name = re.sub(r" (?!\])", lambda _: _GAP, name)  # not the blank of a character class
    grant = (
        rf"(?:licen[sc]ed|released|distributed|available|published|provided|redistribut\w*){_GAP}"
        rf"under{_GAP}(?:the{_GAP})?(?:terms{_GAP}(?:and{_GAP}conditions{_GAP})?of{_GAP}(?:the{_GAP})?)?(?:{name})"
    )
    return [
        Rule(label, "spdx", rf"spdx-licen[sc]e-identifier[:=\s]{{1,4}}(?:{identifier})(?![a-z0-9.+-])", 4, 1.0),
        Rule(label, keyword, rf"{_LEFT}{grant}{_RIGHT}", 3, 0.95),
        Rule(label, "/", rf"(?:https?://)?(?:www\.)?(?:{address})", 3, 0.9),
        Rule(label, keyword, rf"{_LEFT}(?:{name}){_RIGHT}", 2, 0.8),
    ]


def rules() -> list[Rule]:
    """All rules: four forms of each license, and those of every Creative Commons variant."""
    found: list[Rule] = []
    for label, (keyword, name, identifier, address) in _LICENSES.items():
        found += _forms(label.strip(), keyword, name, identifier, address)
    for code, words in _CC_ELEMENTS.items():
        for version in _CC_VERSIONS:
            label = f"cc-{code}-{version}" if version else f"cc-{code}"
            exact = version.replace(".", r"\.")
            tail = rf"(?:[- ](?:v|version )?{exact})" if version else ""
            short = rf"cc[- ]{code.replace('-', '[- ]')}{tail}(?: (?:international|unported))?(?: licen[sc]e)?"
            long = rf"creative commons {words}(?: licen[sc]e)?{tail}(?: (?:international|unported))?(?: licen[sc]e)?"
            address = rf"creativecommons\.org/licenses/{code}/{exact}"
            found += _forms(label, "cc", short, f"cc-{code}-{exact}" if version else f"cc-{code}", address)
            found += _forms(label, "creative", long, f"cc{code}{exact}", address)[1::2]
    return list(dict.fromkeys(found))
