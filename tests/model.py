"""A plain model of the change log, to hold the operators against."""


def apply(records, read_seq=None, delimiter=b","):
    """records: (seq, op, key, end, value); the state as {key: value}."""
    state = {}
    for seq, op, key, end, value in sorted(records, key=lambda r: r[0]):
        if read_seq is not None and seq > read_seq:
            break
        if op == "put":
            state[key] = value
        elif op in ("delete", "single_delete"):
            state.pop(key, None)
        elif op == "delete_range":
            for k in [k for k in state if key <= k < end]:
                del state[k]
        else:
            before = state.get(key, b"")
            state[key] = before + delimiter + value if before else value
    return state


def random_records(rng, n, keys=8):
    out = []
    for seq in range(1, n + 1):
        op = rng.choice(["put", "put", "merge", "merge", "merge", "delete", "single_delete", "delete_range"])
        key = b"k%d" % rng.randrange(keys)
        end = b"k%d" % rng.randrange(keys) if op == "delete_range" else None
        value = rng.choice([b"", b"a", b"bb", b"c,c", b"\x00\xff"]) if op in ("put", "merge") else None
        out.append((seq, op, key, end, value))
    return out


def frame(spark, records, cf="default"):
    from tidelog.schema import OP_LOG

    as_bytes = lambda b: None if b is None else bytearray(b)
    return spark.createDataFrame([(cf, 0, i, s, op, as_bytes(k), as_bytes(e), as_bytes(v), None) for i, (s, op, k, e, v) in enumerate(records)], OP_LOG)


def rows(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}
