"""The catalog of detection codes: 82 pattern rules and 35 analyzer codes, with their patterns in the Java dialect.

Patterns are written for a backtracking engine: what repeats inside a repeat is possessive.
"""

from __future__ import annotations

from dataclasses import dataclass

from packsieve.functions.severity import RANK

#: Shells and interpreters that can run piped text, and words that start them.
SHELLS = "(?:elvish|xonsh|ksh93|pdksh|loksh|rbash|bash|dash|mksh|oksh|posh|yash|fish|tcsh|oils|zsh|csh|ksh|ash|oil|osh|nu|sh)"
INTERPRETERS = (
    r"(?:powershell|runhaskell|runghc|python(?:3(?:\.\d+)?|2)?|pypy|perl6|perl|ruby|php|nodejs|node|luajit|lua|tclsh|wish|deno|bun|(?-i:Rscript)|julia|gawk|mawk|nawk|awk"
    r"|groovy|expect|guile|scala|clojure|clj|racket|chicken|csi|elixir|iex|raku|crystal|babashka|bb|ts-node|tsx|pwsh|(?-i:R))"
)
LAUNCHERS = "(?:busybox|toybox|env|command|exec|setsid|stdbuf|nice)"
_PATH = r"(?:/\S+/)?"
#: The same where a match may start anywhere: from the first slash of a token only, as later ones give no other match.
_FREE_PATH = r"(?:/(?<!/\S{0,200}/)\S+/)?"


def _run(words: str, path: str = _PATH) -> str:
    """One of ``words``, after any number of launcher words with options and assignments, each with an optional path.

    Tokens split in one way only, so the loops are possessive: they neither recurse nor backtrack. One way passes by
    tokens that merely start like one of ``words`` (``env sh=1 bash -c``), the other stops there (``env sh=1``)."""
    end = rf"{_PATH}\b{words}\b"
    item = r"(?:-\S++\s++|{0}\w++=\S*+\s++)*+"
    launch = rf"{LAUNCHERS}\s++"
    past = rf"(?:{_PATH}{launch}{item.format('')})*+"
    stop = rf"(?:(?!{end}){_PATH}{launch}{item.format(f'(?!{end})')})*+"
    if path == _PATH:
        return rf"(?:{past}|{stop}){end}"
    first = rf"{path}(?:{launch}{item.format('')}{past}{_PATH})?"
    return rf"{first}\b{words}\b"


SHELL, INTERPRETER = _run(SHELLS), _run(INTERPRETERS)
FREE_SHELL, FREE_INTERPRETER = _run(SHELLS, _FREE_PATH), _run(INTERPRETERS, _FREE_PATH)
PASTE = r"(?:pastebin\.com|ptpb\.pw|hastebin\.com|paste\.ee|ix\.io|sprunge\.us|termbin\.com|dpaste\.(?:com|org))"
HOME = r"(?:~|\$HOME|\$\{HOME\})"


@dataclass(frozen=True)
class Literal:
    """A pattern that is a text, wherever it stands in a line."""

    text: str
    case_sensitive: bool = False


@dataclass(frozen=True)
class Inert:
    """A pattern on a function's or a variable's name, with one on its code or value: it matches no line. Scans that ask for
    structures match it against the functions and variables themselves (``scan.structure_matches``)."""

    kind: str
    name: str
    value: str | None = None


#: What to do about a pattern rule's finding, by category.
ADVICE = {
    "malicious_code": "Don't build this package. Report it, and look for what an earlier build of it left behind.",
    "command_injection": "Fetch the script by itself, read it, and have it among the sources with a checksum before anything runs it.",
    "credential_theft": "Don't build this package. If it was built, replace the keys and passwords that the line reads.",
    "data_exfiltration": "Don't build this package. Find out what the line sends and to whom, and treat that data as known to others.",
    "privilege_escalation": "A build needs no more rights than its own folder. Ask why this one takes them before it gets any.",
    "persistence": "Look at what the line starts or schedules, and remove it unless the package is there for just that.",
    "obfuscation": "Decode what is hidden without running it, and judge that. Plain packages have no reason to hide code.",
    "cryptomining": "Don't build this package. Stop the process if it runs already.",
    "network_security": "Use the project's own address, by name and over an encrypted protocol.",
    "suspicious_metadata": "Compare the claim with what the package really is, and ask its maintainer.",
    "dependencies": "Check that the name belongs to the software it claims to be.",
    "cryptography": "Verify every source by a strong checksum or a signature.",
    "configuration": "Change the setting if nothing speaks for it.",
}
#: The same for codes of the structural checks.
CODE_ADVICE = {
    "FUNC-001": "Move the download to the sources, with a checksum.", "IOC-001": "Don't build this package: it carries a mark of a known campaign. Check machines that built it.",
    "DEEP-001": "Decode the text without running it and read it first.", "DEEP-002": "Find out what the blob holds; data belongs in a source file with a checksum.",
    "EXEC-REMOTE": "What is fetched can change at any time: have it among the sources, pinned and verified.", "SRC-001": "Take the same source over an encrypted protocol.",
    "SRC-002": "Take the source from where its project publishes it.", "SRC-003": "Ask for a source with a host name that somebody answers for.", "SRC-004": "Write the address out that the short one leads to.",
    "SRC-005": "Find out where the code comes from that is built here.", "SRC-006": "See whether the project itself points to this host.", "SRC-007": "Pin the repository to a commit.",
    "SRC-008": "See whether the project moved; if not, take the source from its own forge.", "CHK-001": "Add checksums for all sources.", "CHK-002": "Replace MD5 by SHA-256 or better.", "CHK-003": "Replace SHA-1 by SHA-256 or better.",
    "CHK-004": "Add checksums for the sources that lack one.", "CHK-005": "Replace SKIP by real checksums where the source is no repository.", "CHK-006": "Bring the list of checksums in line with the sources.", "CHK-008": "Compute the checksum again: this one can't match anything.",
    "PRIV-001": "Take sudo out of the build; files belong below the package folder.", "PRIV-002": "Ask which program needs the bits, and set them for that one only.", "PRIV-003": "Leave the list of those who may become root alone.", "PRIV-004": "See that the capability is the least that the program needs.",
    "PRIV-005": "Modules belong to packages that are built for that.", "PRIV-006": "A hook runs as root already: find out what sudo is for.", "META-002": "Add the signatures that the keys are for, or drop the keys.", "META-003": "Don't let this package take the place of a trusted one.",
    "META-004": "See whether the version really has to go back.", "META-005": "Have the hook beside the recipe under its usual name.", "META-006": "Don't keep changed copies of such a file with this package.", "DEP-001": "See whether the package may stand in for the trusted one.",
    "PROV-001": "Read the changes since the last version before the next build.", "TI-VT-001": "Don't build this package: others know the file as malicious.", "TI-URLHAUS-001": "Don't fetch this source: others know the address as malicious.",
}


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    files: str
    cwe: str | None
    title: str
    patterns: tuple[str | Literal | Inert, ...]
    case_sensitive: bool = False
    enabled: bool = True
    recommendation: str = ""
    description: str = ""

    @property
    def file_types(self) -> tuple[str, ...]:
        return tuple(t for k, t in (("P", "pkgbuild"), ("I", "install_script")) if k in self.files)

    def regexes(self) -> list[tuple[int, str]]:
        """(place, expression) of each pattern that matches lines."""
        out = []
        for n, p in enumerate(self.patterns):
            if isinstance(p, str):
                out.append((n, p if self.case_sensitive else "(?i)" + p))
            elif isinstance(p, Literal):
                out.append((n, ("" if p.case_sensitive else "(?i)" if p.text.isascii() else "(?iu)") + "".join(c if c.isalnum() or c == " " or ord(c) > 127 else f"\\{c}" for c in p.text)))
        return out


def _r(id_, severity, category, files, cwe, title, *patterns, exact=False):
    return Rule(id_, severity, category, files, f"CWE-{cwe}" if cwe else None, title, patterns, exact, recommendation=ADVICE[category])


RULES: list[Rule] = [
    _r("DLE-001", "critical", "command_injection", "PI", 94, "curl output piped into a shell", rf"\bcurl\b.*\|\s*{SHELL}"),
    _r("DLE-002", "critical", "command_injection", "PI", 94, "wget output piped into a shell", rf"\bwget\b.*\|\s*{SHELL}"),
    _r("DLE-003", "critical", "command_injection", "PI", 94, "download, then run", rf"\bcurl\b.*-o\s*\S+.*(?:&&|;)\s*{SHELL}\s", r"\bcurl\b.*-O\b.*(?:&&|;)\s*\./"),
    _r("PASTE-001", "critical", "malicious_code", "PI", 506, "code from a paste site", rf"\b(?:curl|wget)\b.*{PASTE}", rf"https?://(?:[\w.-]+\.)?{PASTE}"),
    _r("SHELL-001", "critical", "malicious_code", "PI", 506, "shell network pseudo-device", r"/dev/(?:tcp|udp)/[^/\s]+/\d+"),
    _r("SHELL-002", "critical", "malicious_code", "PI", 506, "netcat runs a program", r"\bnc\s+(?:\S+\s+)*?-\w*e\b", r"\bncat\s+(?:\S+\s+)*?-\w*e\b", r"\bnc\s+(?:\S+\s+)*?-\w*c\b"),
    _r("SHELL-003", "critical", "malicious_code", "PI", 506, "python network shell", r"\bpython[\d.]*\b.*socket.*connect", r"\bpython[\d.]*\s+-c\b.*import\s+socket"),
    _r("SHELL-004", "critical", "malicious_code", "PI", 506, "socat relay", r"\bsocat\b.*\bexec:", r"\bsocat\b.*\btcp[46]?:"),
    _r("CRED-001", "critical", "credential_theft", "PI", 522, "SSH keys read", r"~/\.ssh/", r"\$(?:HOME|\{HOME\})/\.ssh/", r"/home/[^/\s]+/\.ssh/"),
    _r("CRED-002", "critical", "credential_theft", "PI", 522, "GnuPG keys read", r"~/\.gnupg/", r"\$(?:HOME|\{HOME\})/\.gnupg/"),
    _r("CRED-003", "critical", "credential_theft", "PI", 522, "stored credentials read", r"/etc/shadow\b", r"\.password-store\b", r"\.netrc\b", r"\.aws/credentials\b", r"\.kube/config\b"),
    _r("BROWSER-001", "critical", "credential_theft", "PI", 522, "browser profile read", r"\.mozilla/firefox", r"\.config/google-chrome", r"\.config/chromium", r"\.config/BraveSoftware", r"\.config/vivaldi", r"\.config/opera"),
    _r("BROWSER-002", "critical", "credential_theft", "PI", 522, "browser secrets read", r"\blogins\.json\b", r"\bkey[34]\.db\b", r"\bcookies\.sqlite\b", r"\bLogin Data\b"),
    _r("INSTALL-001", "critical", "malicious_code", "I", 94, "python in an install hook", r"\bpython[\d.]*\s+\S", r"/usr/bin/python"),
    _r("INSTALL-002", "high", "malicious_code", "I", 94, "program run from an install hook", r"(?:^|[;&|]\s*)(?:sh|bash)?\s*/opt/[^/\s]+/\S+\.(?:sh|py|pl|rb|bin|elf)\b", r"(?:^|[;&|(]\s*)\./[\w.-]+\.(?:sh|py|pl|rb|bin|elf)\b"),
    _r("INSTALL-003", "critical", "network_security", "I", 494, "download in an install hook", r"\b(?:curl|wget|aria2c|axel)\b"),
    _r("INSTALL-004", "critical", "malicious_code", "I", 494, "language package manager in an install hook", r"\bpip[23x]?\s+(?:install|run)\b", r"\bpoetry\s+(?:install|add)\b", r"\buv\s+(?:pip|add|run|tool)\b", r"\bpdm\s+(?:install|add)\b", r"\bconda\s+(?:install|create)\b", r"\bcargo\s+install\b", r"\bgo\s+(?:install|get)\b", r"\bgem\s+install\b", r"\bcomposer\s+(?:install|require)\b", r"\bdeno\s+(?:install|run|add)\b"),
    _r("PERSIST-001", "critical", "persistence", "I", 506, "service set up by an install hook", r"\bsystemctl\s+(?:--\S+\s+)*(?:enable|start|daemon-reload)\b", r"/etc/systemd/system/", r"\.config/systemd/user"),
    _r("PERSIST-002", "critical", "persistence", "PI", 506, "timer unit", r"\.timer\b", r"\bOnBootSec\b", r"\bOnUnitActiveSec\b"),
    _r("PERSIST-003", "high", "persistence", "PI", None, "cron job", r"/etc/cron\.|/var/spool/cron", r"\bcrontab\s"),
    _r("PERSIST-004", "critical", "persistence", "PI", 506, "boot script", r"/etc/rc\.local\b", r"/etc/rc\.d/"),
    _r("PERSIST-005", "high", "persistence", "PI", None, "desktop autostart", r"\.config/autostart", r"/etc/xdg/autostart"),
    _r("PERSIST-006", "critical", "persistence", "PI", 506, "name like a system service", r"\bsystemd-(?:init|update|network|login|kernel|core|sys)d\b", r"/usr/lib/systemd/systemd-\w+"),
    _r("CRYPTO-001", "critical", "cryptomining", "PI", 506, "mining pool", r"stratum\+(?:tcp|ssl|tls)://", r"(?:supportxmr\.com|minexmr\.com|nanopool\.org|moneroocean\.stream|hashvault\.pro|2miners\.com)"),
    _r("CRYPTO-002", "critical", "cryptomining", "PI", 506, "mining program", r"\b(?:xmrig|xmr-stak|minerd|cpuminer|ethminer|t-rex|nbminer|lolminer|phoenixminer)\b"),
    _r("CRYPTO-003", "critical", "cryptomining", "PI", 506, "wallet address", r"\b(?:xmr|monero)\b.{0,40}\b[48][0-9AB][1-9A-HJ-NP-Za-km-z]{90,}", r"\b(?:btc|bitcoin)\b.{0,40}\b(?:bc1|[13])[a-km-zA-HJ-NP-Z0-9]{25,}", r"\bwallet\w*\s*=\s*[\"']?[A-Za-z0-9]{26,}", r"(?-i:\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b)", r"(?-i:\bbc1[ac-hj-np-z02-9]{25,60}\b)"),
    _r("EXFIL-001", "critical", "data_exfiltration", "PI", 200, "data posted with curl", r"\bcurl\b.*\s(?:-d|--data(?:-\w+)?)[\s=@]", r"\bcurl\b.*-X\s*POST\b"),
    _r("EXFIL-002", "critical", "data_exfiltration", "PI", 200, "data sent with netcat", r"\|\s*nc\s+\S", r"\bnc\s+\S+\s+\d+\s*<"),
    _r("EXFIL-003", "critical", "data_exfiltration", "PI", 506, "chat webhook", r"discord(?:app)?\.com/api/webhooks", r"api\.telegram\.org/bot"),
    _r("OBF-001", "high", "obfuscation", "PI", 506, "base64 decoded", r"\bbase64\s+(?:-d|-D|--decode)\b", r"\|\s*base64\s+-\w*d"),
    _r("OBF-002", "high", "command_injection", "PI", 95, "eval", r"\beval\s"),
    _r("OBF-003", "high", "obfuscation", "PI", 506, "hex escapes", r"\\x[0-9a-f]{2}", r"\bxxd\s+-r"),
    _r("OBF-004", "medium", "obfuscation", "PI", None, "text pieced from one-letter variables", r"(?:\$\{[a-z]\}\W?){3,}"),
    _r("OBF-005", "high", "obfuscation", "PI", 94, "decompressed into a shell", r"\b(?:gunzip|zcat|gzip\s+-\w*d\w*|bzcat|xzcat)\b.*\|\s*(?:ba)?sh\b", r"\bbase64\b.*\|\s*(?:gunzip|zcat|gzip)\b.*\|\s*(?:ba)?sh\b"),
    _r("OBF-006", "high", "obfuscation", "PI", 506, "word split by quotes", r"(?:[\"'][A-Za-z0-9][\"']){2,}"),
    _r("URL-001", "high", "network_security", "PI", None, "URL with a bare address", r"https?://\d{1,3}(?:\.\d{1,3}){3}"),
    _r("URL-002", "high", "network_security", "PI", None, "shortened URL", r"\b(?:bit\.ly|t\.co|goo\.gl|tinyurl\.com|is\.gd|cli\.gs|ow\.ly|rb\.gy)/"),
    _r("URL-003", "high", "network_security", "PI", None, "dynamic DNS host", r"\.(?:duckdns\.org|no-ip\.(?:com|org|biz)|ddns\.net|hopto\.org|zapto\.org)", r"\.(?:dyndns\.org|dynu\.(?:com|net)|servebeer\.com|sytes\.net)"),
    _r("HIDDEN-001", "high", "malicious_code", "PI", None, "hidden file in the home folder", r"~/\.[a-z0-9]", r"\$(?:HOME|\{HOME\})/\.[a-z0-9]"),
    _r("HIDDEN-002", "high", "malicious_code", "PI", None, "program run from a temporary folder", r"(?:^\s*|[;&|(]\s*|\b(?:exec|sh|bash|python\d?|perl)\s+)/(?:var/)?tmp/\S+", r"\bchmod\s+(?:\S+\s+)*?\+?\w*x\w*\s+/(?:var/)?tmp/"),
    _r("HIDDEN-003", "high", "malicious_code", "PI", None, "program hidden among shared data", r"\b(?:cp|mv|install)\b.*\.(?:elf|bin|sh|py)\b.*/usr/(?:local/)?share/"),
    _r("ENV-001", "critical", "malicious_code", "PI", 426, "library preloading", r"\bLD_PRELOAD\s*=", r"/etc/ld\.so\.preload", exact=True),
    _r("ENV-002", "high", "malicious_code", "I", 426, "search path changed", r"\bexport\s+PATH\s*=", r"(?:^|[;\s])PATH=[^$\s]", exact=True),
    _r("ENV-003", "critical", "persistence", "PI", 506, "shell start file", r"(?:~|\$HOME|\$\{HOME\}|/home/[^/\s]+|/root)/\.(?:bashrc|bash_profile|profile|zshrc|zprofile)\b", r"/etc/(?:profile\b|bash\.bashrc|zsh/)"),
    _r("META-001", "low", "suspicious_metadata", "P", None, "package provides others", r"^\s*provides=", ),
    _r("ATOMIC-001", "critical", "malicious_code", "PI", 506, "known bad npm package", r"\b(?:atomic-lockfile|js-digest|lockfile-js)\b"),
    _r("ATOMIC-002", "critical", "malicious_code", "I", 494, "npm-family tool in an install hook", r"\b(?:npm|pnpm|yarn)\s+(?:i|ci|install|add|exec|dlx)\b", r"\bbun\s+(?:i|install|add|x|run)\b", r"\b(?:npx|bunx|pnpx)\s+\S"),
    _r("ATOMIC-003", "critical", "persistence", "PI", 506, "kernel payload source", r"\bscales\.bpf\.c\b", r"\bsrc/hooks/deps\b"),
    _r("SHELL-005", "critical", "malicious_code", "PI", 94, "perl network shell", r"\bperl\b.*socket.*(?:connect|exec)"),
    _r("SHELL-006", "critical", "malicious_code", "PI", 94, "php network shell", r"\bphp\s+-r\b.*fsockopen"),
    _r("SHELL-007", "critical", "malicious_code", "PI", 94, "script network shell", r"\bruby\b.*(?:TCPSocket|-rsocket)", r"\blua\b.*socket\.tcp", r"\b[gm]?awk\b.*/inet/(?:tcp|udp)/"),
    _r("SHELL-008", "critical", "malicious_code", "PI", 94, "node network shell", r"\bnode(?:js)?\s+-e\b.*require\(.{0,3}net\b.*connect"),
    _r("SHELL-009", "critical", "malicious_code", "PI", 94, "openssl client shell", r"\bopenssl\s+s_client\b.*-connect\b"),
    _r("SHELL-010", "critical", "malicious_code", "PI", 94, "named pipe shell", r"\bmkfifo\b.*(?:\bnc\b|\bncat\b|\bopenssl\b|/dev/tcp)"),
    _r("SHELL-011", "critical", "malicious_code", "PI", 94, "other network shell", r"\bbusybox\s+nc\b.*-e\b", r"\btelnet\s+\S+\s+\d+\s*\|", r"\bncat\b.*--ssl\b.*-e\b"),
    _r("EXFIL-004", "critical", "data_exfiltration", "PI", 200, "data sent by DNS", r"\b(?:dig|nslookup|host)\b.*\$\(", r"\b(?:dig|nslookup)\b.*(?:\bTXT\b|@\S)"),
    _r("EXFIL-006", "high", "data_exfiltration", "PI", 200, "file uploaded with curl", r"\bcurl\b.*\s(?:-T|-F|--upload-file|--data-urlencode)\b"),
    _r("EXFIL-007", "high", "data_exfiltration", "PI", 200, "data posted with wget", r"\bwget\b.*--post-(?:data|file)\b"),
    _r("EXFIL-008", "critical", "data_exfiltration", "PI", 200, "work chat webhook", r"hooks\.slack\.com/", r"\.webhook\.office\.com/|outlook\.office\.com/webhook"),
    _r("EXFIL-009", "high", "data_exfiltration", "PI", 200, "anonymous drop or tunnel", r"(?:transfer\.sh|0x0\.st|file\.io|anonfiles\.com|gofile\.io|catbox\.moe|bashupload\.com|temp\.sh|ngrok(?:-free)?\.(?:io|app)|trycloudflare\.com|serveo\.net)\b"),
    _r("CRED-008", "high", "credential_theft", "PI", 522, "environment sent or saved", r"\b(?:env|printenv)\b\s*(?:\|\s*(?:curl|wget|nc|ncat|base64|xxd|openssl)\b|>\s*\S)"),
    _r("CRED-004", "high", "credential_theft", "PI", 522, "cloud credentials read", r"(?:~|\$HOME|\$\{HOME\})/(?:\.aws|\.config/gcloud|\.azure|\.docker/config\.json|\.npmrc|\.pypirc|\.git-credentials|\.config/gh)\b"),
    _r("CRED-005", "critical", "credential_theft", "PI", 522, "keyring or wallet read", r"\.local/share/keyrings|\bkwallet|\.electrum\b|\.bitcoin/wallet|wallet\.dat\b|\.config/Exodus|\.ethereum/keystore|nkbihfbeogaeaoehlefnkodbefgpgknn"),
    _r("PRIV-007", "critical", "privilege_escalation", "PI", 269, "root-like account", r"\buser(?:add|mod)\b.*\s-\w*[ug]\w*\s+0\b", r"\busermod\b.*-\w*G\s*\S*\b(?:wheel|sudo)\b", r"\bgpasswd\s+-a\b"),
    _r("PRIV-008", "critical", "privilege_escalation", "PI", 269, "password changed", r"\bchpasswd\b", r"\bpasswd\s+(?:-d|--delete)\b", r"\|\s*passwd\b"),
    _r("TAMPER-001", "critical", "privilege_escalation", "PI", 269, "account files written", r"(?:>>?|\btee\b.*)\s*/etc/(?:passwd|shadow|group|gshadow)\b"),
    _r("TAMPER-002", "critical", "privilege_escalation", "PI", 269, "sudo or doas rule", r"/etc/doas\.conf\b", r"\bpermit\s+(?:nopass|persist)\b", r"\bNOPASSWD\b"),
    _r("TAMPER-005", "critical", "privilege_escalation", "PI", 287, "PAM changed", r"\bpam_permit\.so\b", r"(?:>>?|\btee\b.*)\s*/etc/pam\.d/"),
    _r("TAMPER-011", "critical", "malicious_code", "PI", 347, "signature checks off", r"\bSigLevel\s*=\s*Never\b"),
    _r("TAMPER-013", "high", "malicious_code", "PI", 693, "defences off", r"\bsetenforce\s+0\b|\bufw\s+disable\b|\baa-disable\b", r"\bsystemctl\s+(?:\S+\s+)*?(?:stop|disable|mask)\b.*\b(?:apparmor|auditd|firewalld|ufw|clamav\S*)\b", r"\biptables\s+-F\b|\bnft\s+flush\b"),
    _r("TAMPER-017", "high", "malicious_code", "PI", 295, "certificate authority added", r"\btrust\s+anchor\b", r"/(?:ca-certificates/trust-source|ssl/certs|pki)/anchors|/usr/local/share/ca-certificates"),
    _r("TRUST-001", "high", "malicious_code", "PI", 494, "packaging key trusted", r"\bpacman-key\b.*(?:--recv|-r\b|--lsign|-l\b)"),
    _r("TRUST-002", "medium", "malicious_code", "PI", 494, "key imported", r"\bgpg2?\b.*--(?:import|recv|keyserver)"),
    _r("DEP-003", "high", "dependencies", "PI", 494, "package index replaced", r"--(?:extra-)?index-url\b|--registry\b|(?-i:\b(?:PIP_(?:EXTRA_)?INDEX_URL|NPM_CONFIG_REGISTRY|GOPROXY)=)"),
    _r("SRC-009", "high", "network_security", "PI", 94, "disguised address in a URL", r"https?://\[[0-9a-f:.]+\]", r"https?://0x[0-9a-f]{2,8}(?:[:/]|$)", r"https?://\d{8,10}(?:[:/]|$)"),
    _r("OBF-007", "high", "obfuscation", "PI", 506, "printf of escapes", r"\bprintf\b.*(?:\\x[0-9a-f]{1,2}|\\[0-7]{2,3}).*(?:\\x[0-9a-f]{1,2}|\\[0-7]{2,3})"),
    _r("OBF-008", "high", "obfuscation", "PI", 506, "base32 or base16 decoded", r"\b(?:base32|base16|basenc)\b.*(?:-d\b|--decode\b)"),
    _r("OBF-011", "high", "obfuscation", "PI", 94, "shell fed by a here-string", rf"{FREE_SHELL}\s*(?:-\S+\s+)*(?:-\S+)?<<<"),
    _r("EXEC-002", "critical", "malicious_code", "PI", 494, "shell runs a download", rf"{FREE_SHELL}\s+-\w*c\s+[\"']?\$\(\s*(?:curl|wget|aria2c|fetch|http)\b"),
    _r("EXEC-005", "medium", "malicious_code", "PI", 506, "detached process", rf"\b(?:setsid|nohup)\s+(?:curl\b|wget\b|{SHELLS}\b|/tmp/|\./)"),
    _r("EXEC-006", "high", "malicious_code", "PI", 94, "sqlite shell command", r"\bsqlite3\b.*\.(?:shell|system|import)\b"),
    _r("EXEC-007", "high", "command_injection", "PI", 94, "make reads its file from a pipe", r"\|\s*make\b.*-f\s*(?:-(?:\s|$)|/dev/stdin)"),
]

#: (code, severity, category, title, analyzer) of the structural checks.
ANALYZER_CODES = [
    ("FUNC-001", "high", "command_injection", "download inside a build function", "pattern"),
    ("IOC-001", "critical", "malicious_code", "known indicator of a campaign", "ioc"),
    ("DEEP-001", "critical", "obfuscation", "decoded text is executed", "deep"),
    ("DEEP-002", "high", "obfuscation", "long encoded blob", "deep"),
    ("EXEC-REMOTE", "critical", "malicious_code", "remote code fetched and run", "remote_exec"),
    ("SRC-001", "medium", "network_security", "insecure source protocol", "source"),
    ("SRC-002", "high", "network_security", "suspicious source host", "source"),
    ("SRC-003", "high", "network_security", "source at a bare address", "source"),
    ("SRC-004", "high", "network_security", "shortened source URL", "source"),
    ("SRC-005", "medium", "suspicious_metadata", "no sources but a build", "source"),
    ("SRC-006", "low", "network_security", "repository on an unusual host", "source"),
    ("SRC-007", "low", "configuration", "repository not pinned", "source"),
    ("SRC-008", "low", "suspicious_metadata", "source on another forge", "source"),
    ("CHK-001", "high", "cryptography", "no checksums", "checksum"),
    ("CHK-002", "medium", "cryptography", "MD5 checksums", "checksum"),
    ("CHK-003", "medium", "cryptography", "SHA-1 checksums", "checksum"),
    ("CHK-004", "medium", "cryptography", "some sources unverified", "checksum"),
    ("CHK-005", "high", "cryptography", "no source verified", "checksum"),
    ("CHK-006", "high", "cryptography", "checksum count differs", "checksum"),
    ("CHK-008", "medium", "cryptography", "malformed checksum", "checksum"),
    ("PRIV-001", "critical", "privilege_escalation", "sudo in a build function", "privilege"),
    ("PRIV-002", "critical", "privilege_escalation", "special permission bits", "privilege"),
    ("PRIV-003", "critical", "privilege_escalation", "sudoers touched", "privilege"),
    ("PRIV-004", "medium", "privilege_escalation", "capabilities set", "privilege"),
    ("PRIV-005", "high", "privilege_escalation", "kernel module handled", "privilege"),
    ("PRIV-006", "high", "privilege_escalation", "sudo in an install hook", "privilege"),
    ("META-002", "low", "suspicious_metadata", "signing keys without signatures", "metadata"),
    ("META-003", "high", "suspicious_metadata", "trusted package displaced", "metadata"),
    ("META-004", "low", "suspicious_metadata", "epoch set", "metadata"),
    ("META-005", "medium", "suspicious_metadata", "odd install file name", "metadata"),
    ("META-006", "medium", "suspicious_metadata", "sensitive file in backup", "metadata"),
    ("DEP-001", "high", "dependencies", "trusted package name provided", "metadata"),
    ("PROV-001", "high", "suspicious_metadata", "risky behaviour gained", "provenance"),
    ("TI-VT-001", "critical", "malicious_code", "checksum known as malicious", "threat_intel"),
    ("TI-URLHAUS-001", "critical", "malicious_code", "URL known as malicious", "threat_intel"),
]
ANALYZERS = ["pattern", "ioc", "deep", "remote_exec", "source", "checksum", "privilege", "metadata", "threat_intel", "provenance"]


def entries() -> list[dict]:
    """Catalog rows, sorted by id."""
    out = [
        {"id": r.id, "name": r.title, "severity": r.severity, "category": r.category, "recommendation": r.recommendation, "cwe": r.cwe, "owner": "builtin", "pattern_based": True}
        for r in RULES
    ]
    out += [
        {"id": c, "name": t, "severity": s, "category": g, "recommendation": CODE_ADVICE[c], "cwe": None, "owner": a, "pattern_based": False} for c, s, g, t, a in ANALYZER_CODES
    ]
    return sorted(out, key=lambda e: e["id"])


CATALOG_TYPE = "id string, name string, severity string, category string, recommendation string, cwe string, owner string, pattern_based boolean"


def explain(code: str) -> list[dict]:
    """The entry of that id; else all whose id or name holds the text."""
    rows = entries()
    exact = [e for e in rows if e["id"] == code.upper()]
    return exact or [e for e in rows if code.lower() in e["id"].lower() or code.lower() in e["name"].lower()]


def listing(category: str | None = None, severity: str | None = None, owner: str | None = None) -> list[dict]:
    """Catalog rows, worst first and then by id, of one category, severity or analyzer where these are told."""
    asked = {"category": category, "severity": severity, "owner": owner}
    rows = [e for e in entries() if all(v is None or e[k] == v for k, v in asked.items())]
    return sorted(rows, key=lambda e: (RANK[e["severity"]], e["id"]))
