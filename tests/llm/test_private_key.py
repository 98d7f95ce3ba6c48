"""Spans of private keys."""

from shelfmark.llm import secrets


def test_private_key_to_its_end(spark):
    line, begin, end = "MIIEpAIBAAKCAQEA7bq3" * 3, "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    keys = [
        f"{begin}\n{line}\n{line}\nab==\n{end}", f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{line}\n{end}", f"{begin}\n{line}\n{line}\nshort=",
        f"{begin}\\n{line}\\n{end}", f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x - y\n\n{line}\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----", begin,
    ]
    docs = [(i, f"before {k}\nsome words after it, - and -- dashes") for i, k in enumerate(keys)]
    docs.append((90, f"{begin} is a header.\n" + docs[0][1]))
    docs.append((91, begin + "\n" + "- -- " * 100_000 + "\n" + begin + ("\n" + line) * 20_000))
    got = {r.id: [(s.start, s.end) for s in r.spans if s.kind == "private_key"] for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i, k in enumerate(keys):
        assert got[i] == [(7, 7 + len(k))], i
    lead = len(begin) + len(" is a header.\n") + 7
    assert got[90] == [(0, len(begin)), (lead, lead + len(keys[0]))]
    assert got[91] == [(0, len(begin)), (len(begin) + 500_002, len(docs[-1][1]))]
