"""Event ontologies as configuration and as dimension tables.

The full ontologies (hundreds of types) are a *parameter*: pass nested dictionaries, or point
``Ontology.load`` at a JSON file holding them.  Only a small starter set ships with the code.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# A configuration file larger than this is not an ontology.
MAX_CONFIG_BYTES = 64 * 1024 * 1024

# --- fixed values: names of data sets, types, roles and labels -------------------------------
DATASETS = ("geneva", "wikievents", "casie", "genia2013", "m2e2", "rams")
COMBINABLE = ("m2e2", "rams", "wikievents")

_ROLES = {
    "m2e2": {
        "Conflict:Attack": ["Attacker", "Target", "Instrument", "Place"],
        "Conflict:Demonstrate": ["Entity", "Place", "Police"],
        "Contact:Meet": ["Entity", "Place"],
        "Contact:Phone-Write": ["Entity", "Place"],
        "Justice:Arrest-Jail": ["Person", "Agent", "Place"],
        "Life:Die": ["Agent", "Victim", "Instrument", "Place"],
        "Movement:Transport": ["Artifact", "Destination", "Origin", "Vehicle", "Agent"],
        "Transaction:Transfer-Money": ["Giver", "Recipient"],
    },
    "geneva": {
        "Achieve": ["Agent", "Goal", "Means"],
        "Action": ["Act", "Agent", "Domain", "Manner"],
        "Adducing": ["Medium", "Role", "Speaker", "Specified_entity"],
        "Agree_or_refuse_to_act": ["Proposed_action", "Speaker"],
    },
    "rams": {
        "artifactexistence.damagedestroy.damage": ["artifact", "damager", "instrument", "place"],
        "artifactexistence.damagedestroy.destroy": ["artifact", "destroyer", "instrument", "place"],
        "artifactexistence.damagedestroy.n/a": ["artifact", "damagerdestroyer", "instrument", "place"],
        "conflict.attack.airstrikemissilestrike": ["attacker", "instrument", "place", "target"],
    },
    "wikievents": {
        "ArtifactExistence.DamageDestroyDisableDismantle.Damage": ["Artifact", "Damager", "Instrument", "Place"],
        "ArtifactExistence.DamageDestroyDisableDismantle.Destroy": ["Artifact", "Destroyer", "Instrument", "Place"],
        "ArtifactExistence.DamageDestroyDisableDismantle.DisableDefuse": ["Artifact", "Disabler", "Instrument"],
        "ArtifactExistence.DamageDestroyDisableDismantle.Dismantle": [
            "Artifact", "Components", "Dismantler", "Instrument", "Place"],
    },
}

_TYPE_TAGS = {
    "m2e2": {
        "Conflict:Attack": "Conflict Attack",
        "Conflict:Demonstrate": "Conflict Demonstrate",
        "Contact:Meet": "Contact Meet",
        "Contact:Phone-Write": "Contact Phone Write",
        "Justice:Arrest-Jail": "Justice Arrest Jail",
        "Life:Die": "Life Die",
        "Movement:Transport": "Movement Transport",
        "Transaction:Transfer-Money": "Transaction Transfer Money",
    },
    "geneva": {
        "Achieve": "Achieve",
        "Action": "Action",
        "Adducing": "Adducing",
        "Agree_or_refuse_to_act": "Agree Refuse Act",
    },
    "rams": {
        "artifactexistence.damagedestroy.damage": "Artifact Existence Damage Destroy Damage",
        "artifactexistence.damagedestroy.destroy": "Artifact Existence Damage Destroy Destroy",
        "artifactexistence.damagedestroy.n/a": "Artifact Existence Damage Destroy",
        "conflict.attack.airstrikemissilestrike": "Conflict Attack Airstrike Missile Strike",
    },
    "wikievents": {
        "ArtifactExistence.DamageDestroyDisableDismantle.Damage":
            "Artifact Existence Damage Destroy Disable Dismantle Damage",
        "ArtifactExistence.DamageDestroyDisableDismantle.Destroy":
            "Artifact Existence Damage Destroy Disable Dismantle Destroy",
        "ArtifactExistence.DamageDestroyDisableDismantle.DisableDefuse":
            "Artifact Existence Damage Destroy Disable Dismantle Disable Defuse",
        "ArtifactExistence.DamageDestroyDisableDismantle.Dismantle":
            "Artifact Existence Damage Destroy Disable Dismantle Dismantle",
    },
}

_TYPE_MAP = {
    "m2e2": [
        ["Conflict:Attack", "conflict_Attack"],
        ["Conflict:Demonstrate", "conflict_Demonstrate"],
        ["Contact:Meet", "contact_Meet_Correspond"],
        ["Contact:Phone-Write", "contact_Meet_Correspond"],
        ["Justice:Arrest-Jail", "justice_Arrest_Jail_Detain"],
        ["Life:Die", "life_Die_Death"],
        ["Movement:Transport", "movement_Transport_Artifact"],
        ["Transaction:Transfer-Money", "transaction_Transfer_Money"],
    ],
    "rams": [
        ["conflict.attack.airstrikemissilestrike", "conflict_Attack"],
        ["artifactexistence.damagedestroy.damage", "artifact_existence_Damage_Destroy_Disable_Dismantle"],
        ["artifactexistence.damagedestroy.destroy", "artifact_existence_Damage_Destroy_Disable_Dismantle"],
        ["artifactexistence.damagedestroy.n/a", "artifact_existence_Damage_Destroy_Disable_Dismantle"],
    ],
    "wikievents": [
        ["ArtifactExistence.DamageDestroyDisableDismantle.Damage",
         "artifact_existence_Damage_Destroy_Disable_Dismantle"],
        ["ArtifactExistence.DamageDestroyDisableDismantle.Destroy",
         "artifact_existence_Damage_Destroy_Disable_Dismantle"],
        ["ArtifactExistence.DamageDestroyDisableDismantle.DisableDefuse",
         "artifact_existence_Damage_Destroy_Disable_Dismantle"],
        ["ArtifactExistence.DamageDestroyDisableDismantle.Dismantle",
         "artifact_existence_Damage_Destroy_Disable_Dismantle"],
    ],
}

_ROLE_MAP = {
    "m2e2": {
        "Conflict:Attack": {"Attacker": "Attacker", "Target": "Target", "Instrument": "Instrument", "Place": "Place"},
        "Conflict:Demonstrate": {"Entity": "Entity", "Place": "Place", "Police": "Police"},
        "Contact:Meet": {"Entity": "Participant", "Place": "Place"},
        "Contact:Phone-Write": {"Entity": "Participant", "Place": "Place"},
        "Justice:Arrest-Jail": {"Person": "Detainee", "Agent": "Jailer", "Place": "Place"},
        "Life:Die": {"Agent": "Killer", "Victim": "Victim", "Instrument": "Instrument", "Place": "Place"},
        "Movement:Transport": {"Artifact": "Artifact", "Destination": "Destination", "Origin": "Origin",
                               "Vehicle": "Vehicle", "Agent": "Transporter"},
        "Transaction:Transfer-Money": {"Giver": "Giver", "Recipient": "Recipient"},
    },
    "rams": {
        "artifactexistence.damagedestroy.damage": {
            "artifact": "Artifact", "damager": "Damager", "instrument": "Instrument", "place": "Place"},
        "artifactexistence.damagedestroy.destroy": {
            "artifact": "Artifact", "destroyer": "Destroyer", "instrument": "Instrument", "place": "Place"},
        "artifactexistence.damagedestroy.n/a": {
            "artifact": "Artifact", "damagerdestroyer": "Damager", "instrument": "Instrument", "place": "Place"},
        "conflict.attack.airstrikemissilestrike": {
            "attacker": "Attacker", "instrument": "Instrument", "place": "Place", "target": "Target"},
    },
    "wikievents": {
        "ArtifactExistence.DamageDestroyDisableDismantle.Damage": {
            "Artifact": "Artifact", "Damager": "Damager", "Instrument": "Instrument", "Place": "Place"},
        "ArtifactExistence.DamageDestroyDisableDismantle.Destroy": {
            "Artifact": "Artifact", "Destroyer": "Destroyer", "Instrument": "Instrument", "Place": "Place"},
        "ArtifactExistence.DamageDestroyDisableDismantle.DisableDefuse": {
            "Artifact": "Artifact", "Disabler": "Disabler", "Instrument": "Instrument"},
        "ArtifactExistence.DamageDestroyDisableDismantle.Dismantle": {
            "Artifact": "Artifact", "Components": "Components", "Dismantler": "Dismantler",
            "Instrument": "Instrument", "Place": "Place"},
    },
}

_UNIFIED = {
    "conflict_Attack": ("conflict", "Attack", ["Attacker", "Target", "Artifact", "Place", "Instrument"]),
    "conflict_Demonstrate": ("conflict", "Demonstrate", [
        "Entity", "Target", "Place", "Police", "Topic", "Regulator", "Demonstrator"]),
    "contact_Meet_Correspond": ("contact", "Meet/Correspond", ["Participant", "Deceased", "Place"]),
    "justice_Arrest_Jail_Detain": ("justice", "Arrest/Jail/Detain", ["Crime", "Detainee", "Place", "Jailer"]),
    "life_Die_Death": ("life", "Die/Death", ["Killer", "Victim", "Place", "Instrument"]),
    "movement_Transport_Artifact": ("movement", "Transport Artifact", [
        "Hiding_Place", "Vehicle", "Preventer", "Origin", "Artifact", "Destination", "Transporter"]),
    "transaction_Transfer_Money": ("transaction", "Transfer Money", [
        "Giver", "Recipient", "Money", "Place", "Beneficiary", "Preventer"]),
    "artifact_existence_Damage_Destroy_Disable_Dismantle": (
        "artifactexistence", "Damage/Destroy/Disable/Dismantle", [
            "Damager", "Destroyer", "Disabler", "Dismantler", "Components", "Place", "Artifact", "Instrument"]),
}
# --- end of fixed values -----------------------------------------------------------------------


def local_frame(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A small table whose exact size Catalyst knows, so that it may broadcast it on its own judgement."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    cols = list(zip(*rows)) if rows else [[] for _ in arrow.names]
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=schema)


_ROLE_LISTS = "array<struct<t:string,r:array<string>>>"


class Lookup:
    """A dictionary as an expression, for use in the row and inside arrays; nothing is joined or shuffled.

    Spark reads a map literal from its first entry on, so the entries are dealt into buckets by the CRC of their key: a look-up
    costs the same at 20 and at 20,000 entries.  What it holds comes from one configuration file (``MAX_CONFIG_BYTES``).
    """

    def __init__(self, entries: dict, value: str = "string"):
        self.size = max(1, len(entries))
        buckets: list[dict] = [{} for _ in range(self.size)]
        for k, v in entries.items():
            buckets[zlib.crc32(k.encode()) % self.size][k] = v
        self.content, self.schema = json.dumps(buckets), f"array<map<string,{value}>>"

    def __call__(self, key: Column) -> Column:
        """The value of ``key``, NULL where there is none."""
        buckets = F.from_json(F.lit(self.content), self.schema)
        return F.try_element_at(F.get(buckets, (F.crc32(key) % self.size).cast("int")), key)


@dataclass
class Ontology:
    """Nested dictionaries in list order; list order is semantic (first match wins)."""

    roles: dict = field(default_factory=dict)          # data set -> type -> [role]
    type_tags: dict = field(default_factory=dict)      # data set -> type -> display tag
    role_tags: dict = field(default_factory=dict)      # data set -> role -> display tag
    type_map: dict = field(default_factory=dict)       # data set -> [[original, unified]]
    role_map: dict = field(default_factory=dict)       # data set -> original type -> {role: unified role}
    unified: dict = field(default_factory=dict)        # unified type -> {group, secondary_type, description}
    unified_roles: dict = field(default_factory=dict)  # unified type -> [role]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ontology":
        """Read one JSON object whose keys are the field names above."""
        head = spark.read.format("binaryFile").load(path).select("length", "content").limit(2).collect()
        if len(head) != 1 or head[0]["length"] > MAX_CONFIG_BYTES:
            raise ValueError("an ontology is one JSON file of at most 64 MB")
        data = json.loads(bytes(head[0]["content"]).decode("utf-8"))
        return cls(**{k: data.get(k, {}) for k in cls.__dataclass_fields__})

    # ---- flat rows -----------------------------------------------------------------------
    def role_rows(self):
        for ds, types in self.roles.items():
            for t_ord, (t, roles) in enumerate(types.items()):
                for r_ord, r in enumerate(roles or [None]):
                    yield (ds, t, t_ord, r, r_ord)

    def type_rows(self):
        for ds, types in self.roles.items():
            for t_ord, t in enumerate(types):
                yield (ds, t, t_ord)

    def tag_rows(self):
        for d_ord, (ds, tags) in enumerate(self.type_tags.items()):
            for k, v in tags.items():
                yield (ds, d_ord, k, v)

    def type_map_rows(self):
        for ds, pairs in self.type_map.items():
            last = {}
            for p in pairs:                      # malformed pairs are skipped, the last one wins
                if isinstance(p, (list, tuple)) and len(p) == 2:
                    last[p[0]] = p[1]
            for o, u in last.items():
                yield (ds, o, u)

    def role_map_rows(self):
        for ds, types in self.role_map.items():
            for t, roles in types.items():
                for o, (a, b) in enumerate(roles.items()):
                    yield (ds, t, a, b, o)

    def unified_rows(self):
        for u, v in self.unified.items():
            yield (u, v.get("group"), v.get("secondary_type"), v.get("description"))

    # ---- dimension tables (no broadcast hints: Spark broadcasts under its own size threshold) --
    def dim_event_roles(self, spark: SparkSession) -> DataFrame:
        return local_frame(
            spark, list(self.role_rows()), "dataset string, event_type string, type_ord int, role string, role_ord int")

    def dim_types(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, list(self.type_rows()), "dataset string, event_type string, type_ord int")

    def dim_event_tags(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, list(self.tag_rows()), "dataset string, ds_ord int, event_type string, tag string")

    def dim_type_map(self, spark: SparkSession) -> DataFrame:
        return local_frame(
            spark, list(self.type_map_rows()), "dataset string, original_type string, unified_type string")

    def dim_role_map(self, spark: SparkSession) -> DataFrame:
        return local_frame(
            spark, list(self.role_map_rows()),
            "dataset string, original_type string, original_role string, unified_role string, ord int")

    def dim_unified(self, spark: SparkSession) -> DataFrame:
        return local_frame(
            spark, list(self.unified_rows()), "unified_type string, type_group string, secondary_type string, description string")

    # ---- in-row lookups --------------------------------------------------------------------
    def role_lists(self) -> Lookup:
        """``data set, lower-cased type`` → the types of that spelling in order, each with its roles."""
        out: dict = {}
        for ds, t, _ in self.type_rows():
            out.setdefault(f"{ds}\t{t.lower()}", []).append({"t": t, "r": list(self.roles[ds][t])})
        return Lookup(out, _ROLE_LISTS)

    def unified_role_lists(self) -> Lookup:
        """``lower-cased unified type`` → as :meth:`role_lists`."""
        out: dict = {}
        for t, r in self.unified_roles.items():
            out.setdefault(t.lower(), []).append({"t": t, "r": list(r)})
        return Lookup(out, _ROLE_LISTS)

    def unified_type(self) -> Lookup:
        return Lookup({f"{ds}\t{o}": u for ds, o, u in self.type_map_rows()})

    def unified_role(self) -> Lookup:
        return Lookup({f"{ds}\t{t}\t{a}": b for ds, t, a, b, _ in self.role_map_rows()})

    def unified_role_any_case(self) -> Lookup:
        out: dict = {}
        for ds, t, a, b, _ in self.role_map_rows():
            out.setdefault(f"{ds}\t{t}\t{a.lower()}", b)
        return Lookup(out)

    def tag(self) -> Lookup:
        return Lookup({f"{ds}\t{k}": v for ds, _, k, v in self.tag_rows()})

    def tag_anywhere(self) -> Lookup:
        """Type → its tag in the first data set that has it."""
        out: dict = {}
        for _, _, k, v in self.tag_rows():
            out.setdefault(k, v)
        return Lookup(out)


def starter_ontology() -> Ontology:
    """The small built-in set used by the examples, the tests and the registered queries."""
    return Ontology(
        roles=_ROLES,
        type_tags=_TYPE_TAGS,
        type_map=_TYPE_MAP,
        role_map=_ROLE_MAP,
        unified={u: {"group": g, "secondary_type": s, "description": None} for u, (g, s, _) in _UNIFIED.items()},
        unified_roles={u: r for u, (_, _, r) in _UNIFIED.items()},
    )
