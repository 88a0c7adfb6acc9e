import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows):
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over given (name -> (columns, rows)) tables or a scale-factor folder."""

    def run(sql, sf_dir=None, **tables):
        con = duckdb.connect()
        if sf_dir:
            for t in TABLES:
                con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        for name, (columns, rows) in tables.items():
            con.execute(f"create table {name} ({columns})")
            if rows:
                con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
        cur = con.execute(sql)
        return [d[0] for d in cur.description], cur.fetchall()

    return run


@pytest.fixture(scope="session")
def same(duck):
    def check(df, sql, **where):
        names, rows = duck(sql, **where)
        order = sorted(names)
        assert order == sorted(df.columns)
        pick = [names.index(c) for c in order]
        assert canon(tuple(r[c] for c in order) for r in df.collect()) == canon(tuple(r[i] for i in pick) for r in rows)

    return check
