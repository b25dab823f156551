"""Bulk changes as pure functions from tables and batches to new tables; writers stage the result in a new folder."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.functions.text import money
from labframe.operators.lookup import flagged
from labframe.operators.orders import courtesy
from labframe.operators.search import active
from labframe.operators.tree import above, below
from labframe.sources.io import stored
from labframe.sources.schema import SPECS, Reference, TableSpec

#: The column that tells in which order the rows of a batch came.
SEQUENCE = "batch_seq"


def merged(patches: DataFrame, columns: Sequence[str], nullable: bool | Sequence[str] = True, sequence: str = SEQUENCE) -> DataFrame:
    """(id, fields, columns): one patch for each id, of each column what the last patch that gives it says, as if they came one after the other.

    Patches (id, columns) without `fields` give what is not null. Without a column `sequence` a batch has one patch an
    id, or the job fails; of equal sequences the greatest value stays.
    """
    seq = F.col(sequence) if sequence in patches.columns else F.lit(0)
    last = {}
    for c in columns:
        given = F.coalesce(F.array_contains("fields", c), F.lit(False)) if "fields" in patches.columns else F.col(c).isNotNull()
        given = given if nullable is True or (nullable and c in nullable) else given & F.col(c).isNotNull()
        last[c] = F.max(F.when(given, F.struct(seq.alias("seq"), F.col(c).alias("value")))).alias(c)
    out = patches.groupBy("id").agg(F.count("*").alias("n_"), *last.values())
    fields = F.filter(F.array(*(F.when(F.col(c).isNotNull(), c) for c in columns)), lambda c: c.isNotNull())
    if sequence not in patches.columns:
        fields = F.when(F.col("n_") > 1, F.raise_error(F.lit(f"several patches of one id need a column {sequence}"))).otherwise(fields)
    return out.select("id", fields.alias("fields"), *(F.col(c)["value"].alias(c) for c in columns))


def patched(table: DataFrame, patches: DataFrame, columns: Sequence[str], nullable: bool | Sequence[str] = True, sequence: str = SEQUENCE, many: bool = False) -> DataFrame:
    """The table with patches (id, fields, columns) applied to its active rows, several of one id in the order of `sequence`.

    `fields` lists what the patch has, which tells an explicit null from nothing. nullable=False: a null keeps the old value; the
    columns that a null sets can be listed instead. Of `many` patches none are sent to the driver.
    """
    new = merged(patches, columns, nullable, sequence).select("id", "fields", *(F.col(c).alias(f"new_{c}") for c in columns))
    out, on = table.join(new.hint("merge") if many else new, "id", "left"), F.col("isActive") if "isActive" in table.columns else F.lit(True)
    for c in columns:
        given = on & F.coalesce(F.array_contains("fields", c), F.lit(False))
        out = out.withColumn(c, F.when(given, F.col(f"new_{c}")).otherwise(F.col(c)))
    return out.select(*table.columns)


def patch_faults(patches: DataFrame, table: DataFrame, key: list[str], sequence: str = SEQUENCE) -> DataFrame:
    """Patches with the first fault or null: MISSING (no active row), TAKEN (another row, active or not, has the key that the patch sets), REPEATED (an earlier patch of another row sets it).

    Patches are held against the stored rows and each other; a key that the batch frees is free when the batch is stored.
    """
    rows = table.select("id", F.col("isActive").alias("there"), *(F.col(c).alias(f"old_{c}") for c in key))
    out = patches.join(rows, "id", "left")
    wanted = {c: F.when(F.array_contains("fields", c), F.col(c)).otherwise(F.col(f"old_{c}")) for c in key}
    out = out.withColumns({f"key_{c}": v for c, v in wanted.items()})
    holders = table.groupBy(*(F.col(c).alias(f"key_{c}") for c in key)).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    on = [f"key_{c}" for c in key]
    out = out.join(holders, on, "left")
    other = (F.col("least") != F.col("id")) | (F.col("most") != F.col("id"))
    changed, whole = F.lit(False), F.lit(True)
    for c in key:
        changed, whole = changed | ~F.col(f"key_{c}").eqNullSafe(F.col(f"old_{c}")), whole & F.col(f"key_{c}").isNotNull()
    fault = F.when(~F.coalesce("there", F.lit(False)), "MISSING").when(changed & F.coalesce(other, F.lit(False)), "TAKEN")
    out = out.withColumns({"fault": fault, "sets": changed & whole})
    order = F.struct(sequence, "id") if sequence in patches.columns else F.struct("id")
    first = out.where("fault IS NULL AND sets").groupBy(*on).agg(F.min(order)["id"].alias("first"))
    out = out.join(first, on, "left")
    return out.withColumn("fault", F.coalesce("fault", F.when(F.col("sets") & (F.col("first") != F.col("id")), "REPEATED"))).select(*patches.columns, "fault")


#: What a patch of an order can set, and the columns that a present null leaves alone are all of them.
ORDER_FIELDS = ("folio", "patientId", "doctorId", "branchName", "sampleAt", "deliveryAt", "status", "courtesyPercent", "notes")


def orders_patched(orders: DataFrame, patches: DataFrame, patients: DataFrame, doctors: DataFrame, sequence: str = SEQUENCE) -> tuple[DataFrame, DataFrame]:
    """(orders with patches (id, fields, columns of ORDER_FIELDS), patches with the first fault or null).

    Faults: MISSING (no active order), PATIENT, DOCTOR (a changed one has to be active). A patch without faults keeps
    the old value for a null. If it names courtesyPercent, discount and total are computed anew from the stored
    subtotal; items are never touched. Several patches of an order take effect one after the other, each judged by what
    those before it left.
    """
    columns = [c for c in ORDER_FIELDS if c in patches.columns]
    old = orders.select("id", F.col("isActive").alias("there"), F.col("patientId").alias("old_p"), F.col("doctorId").alias("old_d"))
    state = flagged(flagged(patches.join(old, "id", "left"), active(patients), "patientId", "p"), active(doctors), "doctorId", "d")
    seq = F.col(sequence) if sequence in patches.columns else F.lit(0)
    state = state.withColumns({"there": F.coalesce("there", F.lit(False)), "at_": seq})
    # for patient and doctor: nothing to ask, the old one that is not active any more (good until a patch changes it), bad, a change
    for c, column in (("p", "patientId"), ("d", "doctorId")):
        given, same = F.col(column).isNotNull(), F.col(column).eqNullSafe(F.col(f"old_{c}"))
        state = state.withColumns({f"sure_{c}": ~given | F.col(c), f"kept_{c}": given & ~F.col(c) & same, f"bad_{c}": given & ~F.col(c) & ~same, f"new_{c}": given & F.col(c) & ~same})
    first = lambda good: F.min(F.when(F.col("there") & good, F.col("at_")))
    turns = state.groupBy("id").agg(first(F.col("new_p") & F.col("sure_d")).alias("tp"), first(F.col("new_d") & F.col("sure_p")).alias("td"), first(F.col("new_p") & F.col("kept_d")).alias("kp"), first(F.col("new_d") & F.col("kept_p")).alias("kd"))
    # the first accepted change of each; a change beside a kept one is accepted if that has not been changed before
    before = lambda a, b: F.when(a.isNotNull() & (b.isNull() | (a < b)), a)
    tp, td, kp, kd = map(F.col, ("tp", "td", "kp", "kd"))
    p_first = kp.isNotNull() & (kd.isNull() | (kp < kd))
    p1, d1 = F.least(tp, before(kp, td)), F.least(td, before(kd, tp))
    turns = turns.select("id", F.when(p_first, p1).otherwise(F.least(tp, before(kp, d1))).alias("turn_p"), F.when(p_first, F.least(td, before(kd, p1))).otherwise(d1).alias("turn_d"))
    state = state.join(turns, "id")
    refused = lambda c: F.col(f"bad_{c}") | (F.col(f"kept_{c}") & F.coalesce(F.col("at_") > F.col(f"turn_{c}"), F.lit(False)))
    fault = F.when(~F.col("there"), "MISSING").when(refused("p"), "PATIENT").when(refused("d"), "DOCTOR")
    state = state.withColumn("fault", fault).select(*patches.columns, "fault")
    good = state.where("fault IS NULL")
    out = patched(orders, good, columns, nullable=False, sequence=sequence)
    again = flagged(out, good.where(F.array_contains("fields", "courtesyPercent")), "id", "again")
    subtotal = F.col("subtotalAmount").cast("double")
    discount = courtesy(subtotal, F.col("courtesyPercent").cast("double"))
    new = {"discountAmount": discount, "totalAmount": subtotal - discount}
    out = again.withColumns({c: F.when(F.col("again"), money(v)).otherwise(F.col(c)) for c, v in new.items()})
    return out.select(*orders.columns), state


def details_added(details: DataFrame, batch: DataFrame, studies: DataFrame, sequence: str = SEQUENCE) -> tuple[DataFrame, DataFrame]:
    """(details with the good rows of batch, batch with the first fault or null): STUDY (not active), PARENT (given, but no active detail of the study, stored or good and earlier in the batch).

    Without a column `sequence` the batch's ids are its order. Rows of the batch hang together in chains of any length.
    """
    seq = F.col(sequence) if sequence in batch.columns else F.col("id")
    state = flagged(batch.withColumn("at_", seq), active(studies), "studyId", "s")
    parents = active(details).select(F.col("id").alias("parentId"), "studyId", F.lit(True).alias("p"))
    state = state.join(parents, ["parentId", "studyId"], "left")
    inside = state.select(F.col("id").alias("parentId"), "studyId", F.col("at_").alias("parent_at")).groupBy("parentId", "studyId").agg(F.min("parent_at").alias("parent_at"))
    state = state.join(inside, ["parentId", "studyId"], "left")
    hangs = F.col("parentId").isNotNull() & F.col("p").isNull()
    later = F.coalesce(F.col("parent_at") >= F.col("at_"), F.lit(True))
    own = F.when(~F.col("s"), "STUDY").when(hangs & later, "PARENT")
    state = stored(state.withColumns({"fault": own, "link": F.when(hangs & ~later, F.col("parentId"))}), "details")
    bad = below(state.select("id", "link"), state.where("fault IS NOT NULL"), parent="link").select("id", F.lit(True).alias("below_bad")).distinct()
    state = state.join(bad, "id", "left").withColumn("fault", F.coalesce("fault", F.when(F.col("below_bad"), "PARENT"))).select(*batch.columns, "fault")
    return details.unionByName(state.where("fault IS NULL").drop("fault", *({sequence} & set(batch.columns) - set(details.columns))).withColumn("isActive", F.lit(True)), allowMissingColumns=True), state


def with_status(table: DataFrame, patches: DataFrame) -> DataFrame:
    """Any status to any other, on active rows; of several for a row the last."""
    new = merged(patches.drop("fields"), ["status"]).select("id", F.col("status").alias("new"))
    return table.join(new, "id", "left").withColumn("status", F.when(F.col("isActive") & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("status"))).select(*table.columns)


def replaced_children(children: DataFrame, new: DataFrame, link: str, many: bool = False) -> DataFrame:
    """Parents that bring new children lose all old ones; parents that bring none keep theirs. `many`: see patched."""
    parents = new.select(link).distinct()
    return children.join(parents.hint("merge") if many else parents, link, "left_anti").select(*children.columns).unionByName(new.select(*children.columns))


def soft_deleted(table: DataFrame, ids: DataFrame) -> DataFrame:
    return flagged(table, ids, "id", "hit").withColumn("isActive", F.col("isActive") & ~F.col("hit")).select(*table.columns)


def hard_deleted(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def subtree(table: DataFrame, roots: DataFrame, key: str = "id", parent: str = "parentId") -> DataFrame:
    """Ids of the roots and all below them; cycles are no matter."""
    return below(table, roots.select(F.col("id").alias(key)), key, parent).select(F.col(key).alias("id"))


def _links(name: str, tables: dict[str, DataFrame], specs: dict[str, TableSpec]) -> list[tuple[str, Reference]]:
    """(child table, reference) of what refers to a table."""
    return [(child, ref) for child, spec in specs.items() if child in tables for ref in spec.references if ref.table == name]


def _order(name: str, tables: dict[str, DataFrame], specs: dict[str, TableSpec]) -> list[str]:
    """The table and those that a delete in it takes along, parents first."""
    seen: list[str] = []

    def visit(at: str, path: tuple[str, ...]) -> None:
        for child, ref in _links(at, tables, specs):
            if ref.on_delete == "cascade" and child != at:
                if child in path:
                    raise ValueError(f"cascading references go round: {' '.join((*path, child))}")
                visit(child, (*path, child))
        if at not in seen:
            seen.append(at)

    visit(name, (name,))
    return seen[::-1]


def taken_along(tables: dict[str, DataFrame], name: str, ids: DataFrame, specs: dict[str, TableSpec] = SPECS) -> dict[str, DataFrame]:
    """Ids, by table, of the rows that deleting ids would delete along cascading references, those of a table to itself included."""
    gone = {name: ids.select("id")}
    for at in _order(name, tables, specs):
        if at not in gone:
            continue
        links = [(child, ref) for child, ref in _links(at, tables, specs) if ref.on_delete == "cascade"]
        for _, ref in (x for x in links if x[0] == at):
            gone[at] = below(tables[at], gone[at], parent=ref.column)
        for child, ref in (x for x in links if x[0] != at):
            more = tables[child].join(gone[at].select(F.col("id").alias(ref.column)), ref.column, "left_semi").select("id")
            gone[child] = gone[child].unionByName(more).distinct() if child in gone else more
    return gone


def cascaded(tables: dict[str, DataFrame], name: str, ids: DataFrame, specs: dict[str, TableSpec] = SPECS) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes rows of one table along the references. Returns the new tables and the rows of `ids` that are refused.

    A row is refused if a row refers to it, or to what would go with it, by a restricting reference. What hangs below a
    row that is refused may itself be asked for and go. Tables that are not given are taken to have no rows.
    """
    refused = restricted(tables, name, ids, specs)
    gone, out = taken_along(tables, name, ids.select("id").join(refused, "id", "left_anti"), specs), dict(tables)
    for at, going in gone.items():
        for child, ref in _links(at, tables, specs):
            if ref.on_delete == "set_null":
                there = flagged(out[child], going.select(F.col("id").alias(ref.column)), ref.column, "hit", ref.column)
                out[child] = there.withColumn(ref.column, F.when(~F.col("hit"), F.col(ref.column))).select(*out[child].columns)
    for t, rows in gone.items():
        out[t] = out[t].join(rows, "id", "left_anti").select(*out[t].columns)
    return out, refused


def restricted(tables: dict[str, DataFrame], name: str, ids: DataFrame, specs: dict[str, TableSpec] = SPECS) -> DataFrame:
    """Those of ids that something restricts, directly or below what a delete would take along.

    Down: what would go. Up: rows of it that something restricts, and what would have to take these along.
    """
    gone, blocked = taken_along(tables, name, ids, specs), {}
    for at in reversed(_order(name, tables, specs)):
        if at not in gone:
            continue
        found = []
        for child, ref in _links(at, tables, specs):
            if ref.on_delete == "restrict":
                found.append(tables[child].select(F.col(ref.column).alias("id")))
            elif ref.on_delete == "cascade" and child != at and child in blocked:
                found.append(tables[child].join(blocked[child], "id", "left_semi").select(F.col(ref.column).alias("id")))
        if not found:
            continue
        blocked[at] = gone[at].distinct().join(reduce(DataFrame.unionByName, found), "id", "left_semi")
        for _, ref in (x for x in _links(at, tables, specs) if x[0] == at and x[1].on_delete == "cascade"):
            blocked[at] = above(tables[at].join(gone[at], "id", "left_semi"), blocked[at], parent=ref.column)
    return ids.select("id").distinct().join(blocked[name], "id", "left_semi") if name in blocked else ids.select("id").where(F.lit(False))


def roles_assigned(users: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users with new roles, of several requests for one the last, refused requests with MISSING or UNCONFIRMED)."""
    new = merged(wanted.drop("fields"), ["rol"]).select("id", F.col("rol").alias("new"))
    out = users.join(new, "id", "left").withColumn("rol", F.when(F.col("confirmed") & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("rol"))).select(*users.columns)
    state = wanted.join(users.select("id", "confirmed"), "id", "left")
    return out, state.withColumn("fault", F.when(F.col("confirmed").isNull(), "MISSING").when(~F.col("confirmed"), "UNCONFIRMED")).where("fault IS NOT NULL").drop("confirmed")


def users_deleted(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Users without those of ids that are no administrators."""
    return users.join(deletable(users, ids), "id", "left_anti")


def deletable(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ids that are users and no administrators."""
    return users.join(ids.select("id"), "id", "left_semi").where("rol <> 'admin'").select("id")


def users_removed(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """users, user_sessions and user_login_logs without those users: their sessions go, their log rows stay without the user."""
    return cascaded(tables, "users", deletable(tables["users"], ids))[0]


def accounts_confirmed(users: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each token confirms the user of least id that holds it and is used up; whether it has expired is not asked here."""
    first = users.where(F.col("token").isNotNull()).join(tokens.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.min("id").alias("id")).select("id")
    out = flagged(users, first, "id", "hit")
    return out.withColumns({"confirmed": F.col("confirmed") | F.col("hit"), "token": F.when(~F.col("hit"), F.col("token"))}).select(*users.columns)


def external_users(users: DataFrame, logins: DataFrame, promote: bool = False) -> DataFrame:
    """(email, id, action, rol): logins from outside, resolved by address. A new address becomes a confirmed administrator and unassigned users are promoted only if `promote`; else CREATE gives an unassigned user."""
    known = users.groupBy("email").agg(F.min(F.struct("id", "confirmed", "rol")).alias("u"))
    out = logins.select("email").distinct().join(known, "email", "left")
    new = F.col("u.id").isNull()
    rol = F.when(new, F.lit("admin" if promote else "unassigned")).when((F.col("u.rol") == "unassigned") & F.lit(promote), "admin").otherwise(F.col("u.rol"))
    action = F.when(new, "CREATE").when(~F.col("u.confirmed"), "CONFIRM").when(rol != F.col("u.rol"), "PROMOTE").otherwise("KEEP")
    return out.select("email", F.col("u.id").alias("id"), action.alias("action"), rol.alias("rol"))


