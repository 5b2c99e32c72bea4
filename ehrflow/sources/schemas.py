"""The six clinical tables: types, keys, constraints and length limits.

JSON columns are kept as text at rest (portable across parquet readers and
JDBC); :func:`ehrflow.functions.scalars.parse_json_or_empty` turns them into
VARIANT where they are read.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.TimestampNTZType()


def _schema(fields, not_null=()):
    return T.StructType([T.StructField(n, t, n not in not_null) for n, t in fields])


USUARIO = _schema([
    ("documento_id", L), ("tipo_documento", S), ("primer_apellido", S), ("segundo_apellido", S),
    ("primer_nombre", S), ("segundo_nombre", S), ("fecha_nacimiento", D), ("edad", I), ("sexo", S),
    ("genero", S), ("grupo_sanguineo", S), ("factor_rh", S), ("estado_civil", S),
    ("direccion_residencia", S), ("municipio_ciudad", S), ("departamento", S), ("telefono", S),
    ("celular", S), ("correo_electronico", S), ("hashed_password", S), ("ocupacion", S),
    ("entidad_afiliacion", S), ("regimen_afiliacion", S), ("tipo_usuario", S),
    ("datos_adicionales", S), ("created_at", TS), ("updated_at", TS),
], not_null=("documento_id", "hashed_password"))

PROFESIONAL_SALUD = _schema([
    ("id_personal_salud", S), ("nombre_completo", S), ("tipo_profesional", S),
    ("registro_profesional", S), ("cargo_servicio", S), ("firma_path", S), ("contacto", S),
    ("created_at", TS),
], not_null=("id_personal_salud",))

ATENCION = _schema([
    ("atencion_id", S), ("documento_id", L), ("fecha_hora_atencion", TS), ("tipo_atencion", S),
    ("motivo_consulta", S), ("enfermedad_actual", S), ("antecedentes_personales", S),
    ("antecedentes_familiares", S), ("alergias_conocidas", S), ("habitos", S),
    ("medicamentos_actuales", S), ("signos_vitales", S), ("examen_fisico_general", S),
    ("examen_fisico_por_sistemas", S), ("impresion_diagnostica", S),
    ("codigos_cie10", T.ArrayType(S)), ("conducta_plan_manejo", S), ("recomendaciones_paciente", S),
    ("medicos_interconsultados", S), ("procedimientos_realizados", S), ("resultados_paraclinicos", S),
    ("diagnostico_definitivo", S), ("evolucion_medica", S), ("tratamiento_instaurado", S),
    ("formulacion_medica", S), ("educacion_consejeria", S), ("referencia_contrarreferencia", S),
    ("estado_egreso", S), ("profesional_responsable", S), ("firma_paciente_path", S),
    ("fecha_hora_cierre", TS), ("responsable_registro", S), ("created_at", TS), ("updated_at", TS),
], not_null=("atencion_id", "documento_id", "fecha_hora_atencion"))

DIAGNOSTICO = _schema([
    ("diagnostico_id", S), ("atencion_id", S), ("documento_id", L), ("tipo_diagnostico", S),
    ("diagnostico_text", S), ("codigo_cie10", S), ("gravedad", S), ("registro_medico", S),
    ("created_at", TS),
], not_null=("diagnostico_id", "atencion_id", "documento_id"))

TECNOLOGIA_SALUD = _schema([
    ("tecnologia_id", S), ("atencion_id", S), ("documento_id", L), ("descripcion_medicamento", S),
    ("dosis", S), ("via_administracion", S), ("frecuencia", S), ("dias_tratamiento", I),
    ("unidades_aplicadas", I), ("id_personal_salud", S), ("finalidad_tecnologia", S),
    ("registro_administracion", S), ("created_at", TS),
], not_null=("tecnologia_id", "atencion_id", "documento_id"))

EGRESO = _schema([
    ("egreso_id", S), ("atencion_id", S), ("documento_id", L), ("estado_egreso", S),
    ("causas_egreso", S), ("recomendaciones_al_egreso", S), ("fecha_egreso", TS), ("created_at", TS),
], not_null=("egreso_id", "atencion_id", "documento_id"))

SCHEMAS = {
    "usuario": USUARIO,
    "profesional_salud": PROFESIONAL_SALUD,
    "atencion": ATENCION,
    "diagnostico": DIAGNOSTICO,
    "tecnologia_salud": TECNOLOGIA_SALUD,
    "egreso": EGRESO,
}

PRIMARY_KEYS = {
    "usuario": ["documento_id"],
    "profesional_salud": ["id_personal_salud"],
    "atencion": ["documento_id", "atencion_id"],
    "diagnostico": ["documento_id", "diagnostico_id"],
    "tecnologia_salud": ["documento_id", "tecnologia_id"],
    "egreso": ["documento_id", "egreso_id"],
}

NOT_NULL = {name: [f.name for f in s.fields if not f.nullable] for name, s in SCHEMAS.items()}

# (child, child columns, parent, parent columns, cascades on delete)
FOREIGN_KEYS = [
    ("atencion", ["documento_id"], "usuario", ["documento_id"], True),
    ("diagnostico", ["documento_id", "atencion_id"], "atencion", ["documento_id", "atencion_id"], True),
    ("tecnologia_salud", ["documento_id", "atencion_id"], "atencion", ["documento_id", "atencion_id"], True),
    ("tecnologia_salud", ["id_personal_salud"], "profesional_salud", ["id_personal_salud"], False),
    ("atencion", ["profesional_responsable"], "profesional_salud", ["id_personal_salud"], False),
    ("egreso", ["documento_id", "atencion_id"], "atencion", ["documento_id", "atencion_id"], True),
]

# Maximum text lengths of the patient table (VARCHAR(n)).
USUARIO_LENGTHS = {
    "tipo_documento": 30, "primer_apellido": 120, "segundo_apellido": 120, "primer_nombre": 120,
    "segundo_nombre": 120, "sexo": 20, "genero": 60, "grupo_sanguineo": 10, "factor_rh": 5,
    "estado_civil": 50, "municipio_ciudad": 120, "departamento": 120, "telefono": 50, "celular": 50,
    "correo_electronico": 255, "hashed_password": 255, "ocupacion": 150, "entidad_afiliacion": 255,
    "regimen_afiliacion": 80, "tipo_usuario": 80,
}
# Maximum text lengths of the other tables.
PROFESIONAL_LENGTHS = {"nombre_completo": 255, "tipo_profesional": 80, "registro_profesional": 80,
                       "cargo_servicio": 120}
ATENCION_LENGTHS = {"tipo_atencion": 80, "estado_egreso": 80, "responsable_registro": 255}
LENGTHS = {"usuario": USUARIO_LENGTHS, "profesional_salud": PROFESIONAL_LENGTHS, "atencion": ATENCION_LENGTHS}

# Public response fields (password hash, extra data and audit stamps are
# never returned).
PUBLIC_PATIENT_FIELDS = [
    "documento_id", "tipo_documento", "primer_apellido", "segundo_apellido", "primer_nombre",
    "segundo_nombre", "fecha_nacimiento", "edad", "sexo", "genero", "grupo_sanguineo", "factor_rh",
    "estado_civil", "direccion_residencia", "municipio_ciudad", "departamento", "telefono", "celular",
    "correo_electronico", "ocupacion", "entidad_afiliacion", "regimen_afiliacion", "tipo_usuario",
]
PUBLIC_ENCOUNTER_FIELDS = [
    "atencion_id", "fecha_hora_atencion", "tipo_atencion", "motivo_consulta", "impresion_diagnostica",
    "enfermedad_actual", "antecedentes_personales", "antecedentes_familiares", "alergias_conocidas",
    "medicamentos_actuales", "signos_vitales", "examen_fisico_general", "examen_fisico_por_sistemas",
    "conducta_plan_manejo", "codigos_cie10", "profesional_responsable_nombre",
]

# Fields a patch may carry (everything public except the key and the role).
PATCH_FIELDS = [f for f in PUBLIC_PATIENT_FIELDS if f not in ("documento_id", "tipo_usuario")]

# New-encounter command: required fields and the optional ones.
ENCOUNTER_REQUIRED = ["documento_id", "tipo_atencion", "motivo_consulta", "enfermedad_actual",
                      "impresion_diagnostica", "conducta_plan_manejo"]
ENCOUNTER_OPTIONAL = ["antecedentes_personales", "antecedentes_familiares", "alergias_conocidas",
                      "medicamentos_actuales", "signos_vitales", "examen_fisico_general",
                      "examen_fisico_por_sistemas", "codigos_cie10"]
PATIENT_REQUIRED = ["documento_id", "hashed_password"]
