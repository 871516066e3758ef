"""Signatures of licences: regular expressions over lower-case words that single spaces part.

NAMES holds, by hand, a label, the words that gate it, and how the licence is called; whatever the pattern matches has one
of its gates as a whole word.  Each gives three rules: its
machine-readable tag, a grant under it, and its bare name.  TEXTS holds sentences of the licences themselves and of
notices.  Priorities: 1 tag, 2 licence text, 3 grant, 4 name, 5 general notice.
"""

from __future__ import annotations

V = "( (version|v|ver|v r))?"
NAMES = [
    ("gpl-2.0", "gnu", rf"gnu (general public license|gpl){V} ?2( 0)?( only)?"),
    ("gpl-2.0", "gpl gpl2 gplv2", rf"gpl{V} ?2( 0)?( only)?|gplv2"),
    ("gpl-3.0", "gnu", rf"gnu (general public license|gpl){V} ?3( 0)?( only)?"),
    ("gpl-3.0", "gpl gpl3 gplv3", rf"gpl{V} ?3( 0)?( only)?|gplv3"),
    ("gpl", "gnu", r"gnu (general public license|gpl)"),
    ("gpl", "gpl", r"gpl"),
    ("lgpl-2.1", "lesser", rf"(gnu )?lesser general public license{V} ?2 1"),
    ("lgpl-2.1", "lgpl lgpl2 lgplv2", rf"lgpl{V} ?2 1|lgplv2 1"),
    ("lgpl-3.0", "lesser", rf"(gnu )?lesser general public license{V} ?3( 0)?"),
    ("lgpl-3.0", "lgpl lgpl3 lgplv3", rf"lgpl{V} ?3( 0)?|lgplv3"),
    ("lgpl", "lesser", r"(gnu )?lesser general public license"),
    ("lgpl", "library", r"gnu library general public license"),
    ("lgpl", "lgpl", r"lgpl"),
    ("agpl-3.0", "affero", rf"(gnu )?affero general public license{V} ?3( 0)?"),
    ("agpl-3.0", "agpl agpl3 agplv3", rf"agpl{V} ?3( 0)?|agplv3"),
    ("agpl", "affero", r"(gnu )?affero general public license"),
    ("agpl", "agpl", r"agpl"),
    ("gfdl", "documentation", r"gnu free documentation license( version 1 [123])?"),
    ("gfdl", "gfdl", r"gfdl( 1 [123])?"),
    ("apache-1.1", "apache", rf"apache (software )?license{V} ?1 1"),
    ("apache-2.0", "apache", rf"apache (software )?(license|licence){V} ?2( 0)?"),
    ("apache-2.0", "apache apache2 asl al2", r"apache ?2( 0)?|asl 2 0|al2"),
    ("apache", "apache", r"apache (software )?(license|licence)"),
    ("mit", "mit", r"mit (license|licence)"),
    ("mit", "expat", r"expat (license|licence)"),
    ("mit-0", "mit", r"mit (0|no attribution)( license)?"),
    ("x11", "x11", r"x11 (license|licence)"),
    ("bsd-2-clause", "bsd freebsd", r"(bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)( (license|licence))?"),
    ("bsd-3-clause", "bsd", r"(bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)( (license|licence))?"),
    ("bsd-4-clause", "bsd", r"(bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)( (license|licence))?"),
    ("bsd", "bsd", r"bsd( style)? (license|licence)"),
    ("0bsd", "0bsd zero", r"0bsd|zero clause bsd( license)?"),
    ("isc", "isc", r"isc (license|licence)"),
    ("mpl-1.1", "mozilla", rf"mozilla public license{V} ?1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public license{V} ?2( 0)?"),
    ("mpl-2.0", "mpl mpl2", r"mpl ?2( 0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1.0", "eclipse", rf"eclipse public license{V} ?1( 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public license{V} ?2( 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("epl", "epl", r"epl( [12] 0)"),
    ("edl", "eclipse", r"eclipse distribution license"),
    ("cddl", "cddl", r"cddl( 1 [01])?"),
    ("cddl", "distribution", r"common development and distribution license"),
    ("cpl", "common", r"common public license( version 1 0)?"),
    ("eupl", "eupl", r"eupl( (v|version))?( 1 [012])?"),
    ("eupl", "european", r"european union public (license|licence)"),
    ("cecill", "cecill", r"cecill( [abc2])?( license)?"),
    ("osl-3.0", "open", r"open software license( (v|version))?( 3 0)?"),
    ("afl-3.0", "academic", r"academic free license( (v|version))?( 3 0)?"),
    ("artistic-1.0", "artistic", rf"artistic license{V} ?1( 0)?"),
    ("artistic-2.0", "artistic", rf"artistic license{V} ?2( 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("perl", "perl", r"same terms as perl( itself)?"),
    ("python-2.0", "python psf", r"python software foundation license|psf license"),
    ("ruby", "ruby", r"ruby (s )?license"),
    ("php", "php", r"php license( version)?( 3 0[01]?)?"),
    ("zlib", "zlib", r"zlib( libpng)? license"),
    ("libpng", "libpng", r"libpng license( version 2)?"),
    ("openssl", "openssl", r"openssl license"),
    ("bsl-1.0", "boost", r"boost software license( (v|version))?( 1 0)?"),
    ("busl-1.1", "business", r"business source license( 1 1)?"),
    ("sspl-1.0", "sspl", r"sspl( v?1)?"),
    ("sspl-1.0", "server", r"server side public license"),
    ("elastic-2.0", "elastic", r"elastic license( (v|version))?( 2 0)?"),
    ("polyform", "polyform", r"polyform (noncommercial|small business|shield|strict) license"),
    ("unlicense", "unlicense", r"(the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("beerware", "beerware beer", r"beerware( license)?|beer ware license"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("ncsa", "illinois", r"university of illinois( ncsa)?( open source)? license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("unicode", "unicode", r"unicode license( v3)?"),
    ("ofl-1.1", "sil", r"sil open font license( (v|version))?( 1 [01])?"),
    ("odbl", "database odbl", r"open database license|odbl( 1 0)?"),
    ("odc-by", "commons", r"open data commons attribution license"),
    ("pddl", "dedication", r"public domain dedication and license"),
    ("cdla", "community", r"community data license agreement( permissive| sharing)?"),
    ("ogl-uk", "government", r"open government (license|licence)( (v|version))?( [123] 0)?"),
    ("cc0-1.0", "cc0", r"cc0( 1 0)?( universal)?"),
    ("cc0-1.0", "creative", r"creative commons zero( 1 0)?"),
    ("cc-by", "cc", r"cc by( [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa( [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd( [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc( [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa( [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd( [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution( [1-4] [05])?( international| unported)?( license)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike( [1-4] [05])?( international| unported)?( license)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial( [1-4] [05])?( international| unported)?( license)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(ative)?s( [1-4] [05])?( international| unported)?( license)?"),
    ("cc", "creative", r"creative commons( license)?"),
]
TEXTS = [
    ("gpl", "redistribute", 2, r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "warranty", 2, r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "redistribute", 2, r"redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agpl", "redistribute", 2, r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache-2.0", "apache", 2, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", 1, r"(https? )?(www )?apache org licenses license 2 0"),
    ("mit", "permission", 2, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission", 2, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "opensource", 1, r"opensource org licenses mit"),
    ("isc", "permission", 2, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 2, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", 2, r"neither the name of [a-z0-9 ]{1,400}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", 2, r"all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment"),
    ("zlib", "misrepresented", 2, r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", "permission", 2, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("mpl-2.0", "source", 2, r"this source code form is subject to the terms of the mozilla public license v(ersion)? ?2 0"),
    ("unlicense", "unencumbered", 2, r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", 2, r"do what the fuck you want to public license"),
    ("cc-by", "creativecommons", 1, r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", 1, r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", 1, r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", 1, r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", 1, r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", 1, r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0-1.0", "creativecommons", 1, r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "domain", 5, r"(released|placed|dedicated|is)( in| into| to)? the public domain"),
    ("proprietary", "proprietary", 5, r"(proprietary and confidential|proprietary license|confidential and proprietary)"),
    ("all-rights-reserved", "rights", 5, r"all rights reserved"),
    ("unknown-license", "license", 5, r"(see|read|in) (the )?(accompanying )?license( txt| md)? file"),
    ("unknown-license", "licensed", 5, r"licensed under (the )?terms"),
]
#: Confidence of a detection by its priority.
WEIGHTS = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.6, 5: 0.3}


def rules() -> list[dict]:
    """All signatures: label, priority, gate, pattern.  The patterns stand between spaces that are not part of a match."""
    out = []
    for label, gate, name in NAMES:
        out.append((label, 3, gate, rf"(licensed|released|distributed|available|provided|published|covered)( to you)? (under|by) (the )?(terms of )?(the )?({name})"))
        out.append((label, 4, gate, name))
    for label in dict.fromkeys(x[0] for x in NAMES):
        out.append((label, 1, "spdx", rf"spdx license identifier {label.replace('-', ' ').replace('.', ' ')}( only| or later)?"))
    out += [(label, priority, gate, pattern) for label, gate, priority, pattern in TEXTS]
    return [{"label": a, "priority": b, "gates": [f" {g} " for g in c.split()], "pattern": f"(?<= )(?:{d})(?= )"} for a, b, c, d in out]
