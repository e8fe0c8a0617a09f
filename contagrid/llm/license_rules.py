"""License signatures over lower-cased words with single blanks between them, and the rules built from them."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A signature: ``pattern`` is tried only on texts that contain ``keyword``; a priority is 1000 times its form's, plus a place."""

    label: str
    form: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


#: Phrases whose places are counted, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label, SPDX identifier as words, a word every name contains, names, address words,
#: and sentences of the license text. More specific licenses come before the families they belong to.
LICENSES = (
    ("mit", "expat", "expat", r"expat licen[cs]e", "spdx org licen[cs]es expat", ()),
    ("mit", "mit", "mit", r"mit licen[cs]e", "opensource org licen[cs]es mit", ("permission is hereby granted free of charge to any person obtaining a copy",)),
    ("mit-0", "mit 0", "mit", r"mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e", "opensource org licen[cs]es mit 0", ()),
    ("apache-2", "apache 2 0", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?|apache 2(?: 0)? licen[cs]e", "apache org licen[cs]es licen[cs]e 2 0", ("you may not use this file except in compliance with the license",)),
    ("apache-1.1", "apache 1 1", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?1 1", "apache org licen[cs]es licen[cs]e 1 1", ()),
    ("apache-1", "apache 1 0", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?1 0", "apache org licen[cs]es licen[cs]e 1 0", ()),
    ("apache", "apache", "apache", r"apache (?:software )?licen[cs]e", "apache org licen[cs]es", ()),
    ("bsd-2-clause", "bsd 2 clause", "bsd", r"(?:simplified|freebsd|2 clause) bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?", "opensource org licen[cs]es bsd 2 clause", ()),
    ("bsd-3-clause", "bsd 3 clause", "bsd", r"(?:new|modified|revised|3 clause) bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?", "opensource org licen[cs]es bsd 3 clause", ()),
    ("bsd-3-clause", "bsd 3 clause attribution", "bsd", r"bsd with attribution", "spdx org licen[cs]es bsd 3 clause", ("neither the name of the copyright holder nor the names of its contributors",)),
    ("bsd-4-clause", "bsd 4 clause", "bsd", r"(?:original|old|4 clause) bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?", "spdx org licen[cs]es bsd 4 clause", ()),
    ("0bsd", "0bsd", "bsd", r"zero clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?|0bsd licen[cs]e", "opensource org licen[cs]es 0bsd", ()),
    ("bsd", "bsd", "bsd", r"bsd(?: style)? licen[cs]e", "opensource org licen[cs]es bsd licen[cs]e", ("redistribution and use in source and binary forms with or without modification",)),
    ("isc", "isc", "isc", r"isc licen[cs]e", "opensource org licen[cs]es isc", ("permission to use copy modify and or distribute this software for any purpose",)),
    ("agpl-3", "agpl 3 0(?: only| or later)?", "affero", r"(?:gnu )?affero general public licen[cs]e (?:version |v)?3(?: 0)?|affero gpl v?3", "gnu org licen[cs]es agpl 3 0", ()),
    ("agpl", "agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "gnu org licen[cs]es agpl", ()),
    ("lgpl-2", "lgpl 2 0(?: only| or later)?", "general public", r"(?:gnu )?(?:library|lesser) general public licen[cs]e (?:version |v)?2(?: 0)?", "gnu org licen[cs]es lgpl 2 0", ()),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?2 1", "gnu org licen[cs]es lgpl 2 1", ()),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?", "gnu org licen[cs]es lgpl 3 0", ()),
    ("lgpl", "lgpl", "gpl", r"lgpl licen[cs]e|gnu lgpl", "gnu org licen[cs]es lgpl", ()),
    ("lgpl", "lgpl any", "lesser", r"(?:gnu )?lesser general public licen[cs]e", "gnu org copyleft lesser", ()),
    ("gpl-1", "gpl 1 0(?: only| or later)?", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)?1(?: 0)?", "gnu org licen[cs]es gpl 1 0", ()),
    ("gpl-2", "gpl 2 0(?: only| or later)?", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?", "gnu org licen[cs]es gpl 2 0", ()),
    ("gpl-3", "gpl 3 0(?: only| or later)?", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?", "gnu org licen[cs]es gpl 3 0", ()),
    ("gpl-2", "gpl 2", "gpl", r"gnu gpl v?2|gpl v2|gpl version 2", "gnu org licen[cs]es old licen[cs]es gpl 2 0", ()),
    ("gpl-3", "gpl 3", "gpl", r"gnu gpl v?3|gpl v3|gpl version 3", "gnu org licen[cs]es quick guide gplv3", ()),
    ("gpl", "gpl", "gnu", r"gnu general public licen[cs]e|gnu gpl", "gnu org licen[cs]es gpl", ("either version 2 of the license or at your option any later version", "either version 3 of the license or at your option any later version")),
    ("gfdl-1.2", "gfdl 1 2(?: only| or later)?", "documentation", r"(?:gnu )?free documentation licen[cs]e (?:version |v)?1 2", "gnu org licen[cs]es fdl 1 2", ()),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", "documentation", r"(?:gnu )?free documentation licen[cs]e (?:version |v)?1 3", "gnu org licen[cs]es fdl 1 3", ()),
    ("gfdl", "gfdl", "documentation", r"gnu free documentation licen[cs]e", "gnu org licen[cs]es fdl", ()),
    ("mpl-1.1", "mpl 1 1", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 1", "mozilla org mpl 1 1", ()),
    ("mpl-2", "mpl 2 0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?2(?: 0)?", "mozilla org mpl 2 0", ("this source code form is subject to the terms of the mozilla public license",)),
    ("mpl", "mpl", "mozilla", r"mozilla public licen[cs]e", "mozilla org mpl", ()),
    ("epl-1", "epl 1 0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?1(?: 0)?", "eclipse org legal epl v10", ()),
    ("epl-2", "epl 2 0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?2(?: 0)?", "eclipse org legal epl 2 0", ()),
    ("edl-1", "edl 1 0", "eclipse", r"eclipse distribution licen[cs]e", "eclipse org org documents edl v10", ()),
    ("cpl-1", "cpl 1 0", "common", r"common public licen[cs]e(?: version 1 0)?", "opensource org licen[cs]es cpl1 0", ()),
    ("cpal-1", "cpal 1 0", "common", r"common public attribution licen[cs]e", "opensource org licen[cs]es cpal 1 0", ()),
    ("cddl-1", "cddl 1 0", "common", r"common development and distribution licen[cs]e", "opensource org licen[cs]es cddl 1 0", ()),
    ("eupl-1.1", "eupl 1 1", "european", r"european union public licen[cs]e (?:version |v)?1 1", "joinup ec europa eu eupl v1 1", ()),
    ("eupl-1.2", "eupl 1 2", "european", r"european union public licen[cs]e(?: (?:version |v)?1 2)?", "joinup ec europa eu eupl", ()),
    ("cecill-2.1", "cecill 2 1", "cecill", r"cecill (?:free software )?licen[cs]e(?: agreement)?", "cecill info licen[cs]es licence cecill v2 1", ()),
    ("cecill-b", "cecill b", "cecill", r"cecill b(?: free software)? licen[cs]e", "cecill info licen[cs]es licence cecill b", ()),
    ("artistic-1", "artistic 1 0", "artistic", r"artistic licen[cs]e (?:version |v)?1(?: 0)?", "opensource org licen[cs]es artistic 1 0", ()),
    ("artistic-2", "artistic 2 0", "artistic", r"artistic licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "opensource org licen[cs]es artistic 2 0", ()),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "opensource org licen[cs]es zlib", ()),
    ("libpng", "libpng", "libpng", r"libpng licen[cs]e(?: (?:version |v)?2)?", "libpng org pub png src libpng license", ()),
    ("bsl-1", "bsl 1 0", "boost", r"boost software licen[cs]e(?: (?:version |v)?1 0)?", "boost org licen[cs]e 1 0", ()),
    ("unlicense", "unlicense", "unlicense", r"the unlicense", "unlicense org", ("this is free and unencumbered software released into the public domain",)),
    ("wtfpl", "wtfpl", "what the", r"do what the [a-z]+ you want to public licen[cs]e", "wtfpl net", ()),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[cs]e", "opensource org licen[cs]es postgresql", ()),
    ("python-2", "python 2 0", "python", r"python software foundation licen[cs]e", "docs python org 3 licen[cs]e", ()),
    ("ruby", "ruby", "ruby", r"ruby licen[cs]e", "ruby lang org en about licen[cs]e", ()),
    ("php-3", "php 3 0(?: 1)?", "php", r"php licen[cs]e(?: (?:version |v)?3(?: 0 ?1?)?)?", "php net licen[cs]e", ()),
    ("openssl", "openssl", "openssl", r"openssl licen[cs]e", "openssl org source licen[cs]e", ()),
    ("ms-pl", "ms pl", "microsoft", r"microsoft public licen[cs]e", "opensource org licen[cs]es ms pl", ()),
    ("ms-rl", "ms rl", "microsoft", r"microsoft reciprocal licen[cs]e", "opensource org licen[cs]es ms rl", ()),
    ("ofl-1.1", "ofl 1 1", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version |v)?1 1)?", "scripts sil org ofl", ()),
    ("afl-3", "afl 3 0", "academic free", r"academic free licen[cs]e(?: (?:version |v)?3(?: 0)?)?", "opensource org licen[cs]es afl 3 0", ()),
    ("osl-3", "osl 3 0", "open software", r"open software licen[cs]e(?: (?:version |v)?3(?: 0)?)?", "opensource org licen[cs]es osl 3 0", ()),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "opensource org licen[cs]es ncsa", ()),
    ("upl-1", "upl 1 0", "universal permissive", r"universal permissive licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "opensource org licen[cs]es upl", ()),
    ("vim", "vim", "vim", r"vim licen[cs]e", "vimhelp org uganda txt", ()),
    ("w3c", "w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e", "w3 org consortium legal copyright software", ()),
    ("x11", "x11", "x11", r"x11 licen[cs]e", "spdx org licen[cs]es x11", ()),
    ("curl", "curl", "curl", r"curl licen[cs]e", "curl se docs copyright", ()),
    ("beerware", "beerware", "beer", r"beer ?ware licen[cs]e", "spdx org licen[cs]es beerware", ()),
    ("cc0-1", "cc0 1 0", "cc0", r"cc0 (?:1 0 )?universal|cc0 licen[cs]e", "creativecommons org publicdomain zero 1 0", ()),
    ("cc0-1", "cc zero", "creative commons", r"creative commons zero", "creativecommons org publicdomain zero", ()),
    ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?", "cc by", r"cc by nc sa", "creativecommons org licen[cs]es by nc sa", ()),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?", "cc by", r"cc by nc nd", "creativecommons org licen[cs]es by nc nd", ()),
    ("cc-by-nc", "cc by nc(?: [1-4] [05])?", "cc by", r"cc by nc", "creativecommons org licen[cs]es by nc", ()),
    ("cc-by-nd", "cc by nd(?: [1-4] [05])?", "cc by", r"cc by nd", "creativecommons org licen[cs]es by nd", ()),
    ("cc-by-sa", "cc by sa(?: [1-4] [05])?", "cc by", r"cc by sa", "creativecommons org licen[cs]es by sa", ()),
    ("cc-by", "cc by(?: [1-4] [05])?", "cc by", r"cc by (?:[1-4] [05]|licen[cs]e)", "creativecommons org licen[cs]es by", ()),
    ("cc-by-nc-sa", "cc attribution noncommercial sharealike", "attribution", r"attribution non ?commercial share ?alike", "creativecommons org licen[cs]es by nc sa 4 0", ()),
    ("cc-by-nc-nd", "cc attribution noncommercial noderivatives", "attribution", r"attribution non ?commercial no ?deriv(?:ative)?s", "creativecommons org licen[cs]es by nc nd 4 0", ()),
    ("cc-by-nc", "cc attribution noncommercial", "attribution", r"(?:creative commons )?attribution non ?commercial", "creativecommons org licen[cs]es by nc 4 0", ()),
    ("cc-by-nd", "cc attribution noderivatives", "attribution", r"(?:creative commons )?attribution no ?deriv(?:ative)?s", "creativecommons org licen[cs]es by nd 4 0", ()),
    ("cc-by-sa", "cc attribution sharealike", "attribution", r"(?:creative commons )?attribution share ?alike", "creativecommons org licen[cs]es by sa 4 0", ()),
    ("cc-by", "cc attribution", "creative commons", r"creative commons attribution", "creativecommons org licen[cs]es by 4 0", ()),
    ("odbl-1", "odbl 1 0", "database", r"open (?:data commons open )?database licen[cs]e", "opendatacommons org licen[cs]es odbl", ()),
    ("odc-by-1", "odc by 1 0", "open data", r"open data commons attribution licen[cs]e", "opendatacommons org licen[cs]es by", ()),
    ("pddl-1", "pddl 1 0", "public domain", r"public domain dedication and licen[cs]e", "opendatacommons org licen[cs]es pddl", ()),
    ("sspl-1", "sspl 1 0", "server side", r"server side public licen[cs]e", "mongodb com licen[cs]ing server side public licen[cs]e", ()),
    ("busl-1.1", "busl 1 1", "business source", r"business source licen[cs]e(?: 1 1)?", "mariadb com bsl11", ()),
    ("elastic-2", "elastic 2 0", "elastic", r"elastic licen[cs]e(?: 2 0)?", "elastic co licen[cs]ing elastic licen[cs]e", ()),
    ("polyform-nc-1", "polyform noncommercial 1 0 0", "polyform", r"polyform noncommercial licen[cs]e", "polyformproject org licen[cs]es noncommercial", ()),
    ("openrail", "openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?", "bigscience huggingface co blog the bigscience rail licen[cs]e", ()),
    ("lppl-1.3c", "lppl 1 3c", "latex", r"latex project public licen[cs]e", "latex project org lppl", ()),
    ("mulanpsl-2", "mulanpsl 2 0", "mulan", r"mulan (?:permissive software licen[cs]e|psl)(?: v2)?", "licen[cs]e coscl org cn mulanpsl2", ()),
    ("apsl-2", "apsl 2 0", "apple", r"apple public source licen[cs]e", "opensource apple com apsl", ()),
    ("qpl-1", "qpl 1 0", "public licen", r"q public licen[cs]e", "opensource org licen[cs]es qpl 1 0", ()),
    ("sleepycat", "sleepycat", "sleepycat", r"sleepycat licen[cs]e", "opensource org licen[cs]es sleepycat", ()),
    ("json", "json", "json", r"json licen[cs]e", "json org licen[cs]e", ("the software shall be used for good not evil",)),
    ("public-domain", "public domain", "public domain", r"(?:released|dedicated) (?:in)?to the public domain|public domain work", "creativecommons org publicdomain mark 1 0", ()),
    ("all-rights-reserved", "all rights reserved", "rights reserved", r"all rights reserved", "", ()),
)

#: How a license is granted, in front of its name.
GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published|redistributed)(?: only)? under (?:the )?(?:terms of )?(?:the )?(?:gnu )?"


def rules() -> list[Rule]:
    """All rules in order: each license as SPDX tag, sentence of its text, address, grant and bare name."""
    made = []
    for place, (label, tag, keyword, names, address, sentences) in enumerate(LICENSES):
        # The first word that stands for itself only: a keyword is no pattern.
        host = next((w for w in address.split(" ") if w.isalnum()), "")
        made.append(Rule(label, "tag", "spdx", rf"spdx licen[cs]e identifier {tag}", 1000 + place, 0.99))
        made += [Rule(label, "text", " ".join(s.split(" ")[:3]), s, 2000 + place, 0.97) for s in sentences]
        if address:
            made.append(Rule(label, "address", host, address, 3000 + place, 0.93))
        made.append(Rule(label, "grant", keyword, rf"{GRANT}(?:{names})", 4000 + place, 0.95))
        made.append(Rule(label, "name", keyword, f"(?:{names})", 5000 + place, 0.7))
    made += [Rule(label, "base", phrase, phrase, 5999, 0.9) for phrase, label in BASE.items()]
    return sorted(made, key=lambda rule: rule.priority)
