"""Fixed values of the SQL side, written out on their own: they are not taken from the library
(nor the other way round), so that a wrong value on either side turns its query red."""

# Fixed values that must equal the inventory's
AMOUNT_LIMIT = 999999.0
BENEFITS = (('sql_server_licenses', 85000),
 ('hardware_and_infrastructure', 48000),
 ('it_operations_staff', 72000),
 ('audit_and_compliance_manual_work', 45500),
 ('security_incident_reduction', 42000))
CATEGORY_LAYERS = (('Security', 'Seguridad & Identidad'),
 ('Identity', 'Seguridad & Identidad'),
 ('Compute', 'Compute'),
 ('Database', 'Base de Datos'),
 ('Data', 'Datos & Gobernanza'),
 ('Governance', 'Datos & Gobernanza'),
 ('Audit', 'Audit & Compliance'),
 ('Compliance', 'Audit & Compliance'),
 ('Operations', 'Operaciones'),
 ('Analytics', 'Operaciones'),
 ('Storage', 'Operaciones'))
COST_LINES = ((1, 'Licencias SQL Server Enterprise', 85000, 0),
 (2, 'Hardware e infraestructura', 48000, 0),
 (3, 'Operaciones IT (FTEs infra)', 72000, 0),
 (4, 'Auditorías manuales de compliance', 45500, 0),
 (5, 'Incidentes de seguridad', 42000, 5000),
 (6, 'Infraestructura cloud (AWS)', 0, None))
COUNTRIES = ('US', 'CO', 'MX', 'ES', 'GB', 'DE', 'FR', 'BR', 'AR', 'CL', 'PE')
COUNTRY_CURRENCIES = {'CO': ('COP', 'USD'),
 'ES': ('EUR', 'USD'),
 'GB': ('GBP', 'USD'),
 'US': ('USD',),
 'MX': ('MXN', 'USD'),
 'DE': ('EUR',),
 'FR': ('EUR',)}
CURRENCIES = ('USD', 'EUR', 'COP', 'GBP', 'MXN')
FRAMEWORKS = ('PCI-DSS', 'SOX', 'GDPR', 'Basel III', 'NIST_CSF', 'OFAC', 'AML', 'DORA')
FRAMEWORK_GAPS = (('PCI-DSS',
  'pci_readiness_score',
  '<',
  60,
  'readiness',
  'Controles de acceso y cifrado insuficientes'),
 ('SOX',
  'sox_traceability_score',
  '<',
  60,
  'readiness',
  'Trazabilidad de transacciones incompleta'),
 ('GDPR', 'pii_exposure_score', '>=', 60, 'exposure', 'PII almacenado en texto plano'),
 ('Basel III',
  'encryption_coverage_score',
  '<',
  50,
  'coverage',
  'Cobertura de cifrado insuficiente'))
HIGH_SEVERITY_CODES = ('payment_id_nulo',
 'amount_nulo',
 'amount_negativo',
 'amount_no_numerico',
 'amount_supera_limite',
 'completado_sin_monto',
 'status_nulo',
 'status_invalido',
 'currency_nulo',
 'currency_no_habilitada')
KPI_NAMES = ('Estrategia recomendada',
 'Duración implementación',
 'Inversión total',
 'Ahorro neto anual',
 'Payback',
 'ROI a 3 años',
 'Ahorro acumulado 3 años',
 'Hallazgos de compliance',
 'Riesgo regulatorio',
 'DQ Score')
MILESTONES = (('rehost', 1, 'CloudTrail + KMS activos'),
 ('rehost', 4, 'RDS provisionado y datos migrados'),
 ('rehost', 7, 'Aplicación en EC2 validada'),
 ('rehost', 8, 'Go-live y cutover completado'),
 ('replatform', 4, 'Fundamentos de seguridad completos'),
 ('replatform', 8, 'Control Tower + Audit Manager activos'),
 ('replatform', 13, 'Aurora + EKS en producción'),
 ('replatform', 16, 'Certificación PCI-DSS obtenida'),
 ('refactor', 6, 'Fundamentos de seguridad completos'),
 ('refactor', 12, 'Gobernanza y linaje de datos activos'),
 ('refactor', 20, 'Microservicios en EKS + Aurora'),
 ('refactor', 24, 'Certificación PCI-DSS + documentación SOX'),
 ('rebuild', 6, 'Arquitectura cloud-native diseñada y aprobada'),
 ('rebuild', 12, 'Fundamentos AWS completos'),
 ('rebuild', 24, 'MVP cloud-native en producción'),
 ('rebuild', 36, 'Migración completa + certificación PCI-DSS'),
 ('hybrid', 4, 'Fundamentos de seguridad completos'),
 ('hybrid', 8, 'Gobernanza activa'),
 ('hybrid', 16, 'Migración híbrida completada'),
 ('hybrid', 20, 'Arquitectura consolidada + auditoría PCI-DSS'))
PAGE_DIMENSIONS = (('Cloud Readiness', 'cloud_readiness_score', True),
 ('Data Quality', 'data_quality_score', True),
 ('Security Risk', 'security_risk_score', False),
 ('Compliance Risk', 'compliance_risk_score', False),
 ('PCI-DSS', 'pci_readiness_score', True),
 ('SOX Traceability', 'sox_traceability_score', True),
 ('PII Exposure', 'pii_exposure_score', False),
 ('Encryption', 'encryption_coverage_score', True),
 ('Auditability', 'auditability_score', True),
 ('Reg. Risk', 'regulatory_risk_score', False),
 ('OFAC', 'ofac_sanctions_score', False),
 ('AML Risk', 'aml_risk_score', False),
 ('DORA', 'dora_resilience_score', False))
PHASES = (('rehost',
  1,
  'Preparación y Seguridad Base',
  '1-2',
  ('Habilitar CloudTrail', 'Cifrar S3 con KMS', 'Migrar credenciales a Secrets Manager')),
 ('rehost',
  2,
  'Lift-and-Shift',
  '3-6',
  ('Provisionar VPC + subnets', 'Migrar SQL Server a RDS', 'Desplegar app en EC2')),
 ('rehost',
  3,
  'Validación y Go-Live',
  '7-8',
  ('Pruebas de regresión', 'Cutover con rollback plan', 'Monitoreo post-migración')),
 ('replatform',
  1,
  'Fundamentos de Seguridad',
  '1-4',
  ('CloudTrail + KMS + Secrets Manager', 'Security Hub PCI-DSS', 'AWS Config reglas críticas')),
 ('replatform',
  2,
  'Gobernanza y Datos',
  '5-8',
  ('Control Tower Landing Zone', 'Audit Manager PCI+SOX', 'Glue + Lake Formation')),
 ('replatform',
  3,
  'Migración de Plataforma',
  '9-13',
  ('Aurora PostgreSQL Multi-AZ', 'DMS migration', 'Containerizar en EKS')),
 ('replatform',
  4,
  'Operaciones',
  '14-16',
  ('QuickSight dashboards', 'GuardDuty', 'Certificación PCI-DSS')),
 ('refactor',
  1,
  'Fundamentos de Seguridad',
  '1-6',
  ('CloudTrail + KMS + Secrets Manager', 'Security Hub', 'Remediación DQ crítica')),
 ('refactor',
  2,
  'Gobernanza y Control',
  '7-12',
  ('Control Tower', 'Audit Manager', 'Macie + Lake Formation + Glue')),
 ('refactor',
  3,
  'Refactorización y Migración',
  '13-20',
  ('Descomponer monolito en microservicios', 'Aurora + EKS + Cognito', 'DMS + validación DQ')),
 ('refactor',
  4,
  'Optimización',
  '21-24',
  ('QuickSight', 'Automatización Config Rules', 'Auditoría PCI-DSS QSA')),
 ('rebuild',
  1,
  'Diseño de Arquitectura Cloud-Native',
  '1-6',
  ('Diseño de microservicios', 'Definición de APIs', 'Arquitectura de datos objetivo')),
 ('rebuild',
  2,
  'Fundamentos AWS',
  '7-12',
  ('Control Tower + Security Hub + Audit Manager', 'Aurora + EKS + KMS', 'Cognito + IAM')),
 ('rebuild',
  3,
  'Desarrollo Cloud-Native',
  '13-24',
  ('Desarrollo de microservicios en EKS',
   'Migración de datos con DMS',
   'Pruebas de compliance')),
 ('rebuild',
  4,
  'Certificación y Go-Live',
  '25-36',
  ('Auditoría PCI-DSS QSA', 'Cutover con rollback', 'Documentación SOX completa')),
 ('hybrid',
  1,
  'Fundamentos de Seguridad',
  '1-4',
  ('CloudTrail + KMS + Secrets Manager', 'Security Hub + AWS Config')),
 ('hybrid',
  2,
  'Gobernanza',
  '5-8',
  ('Control Tower', 'Audit Manager', 'Glue + Lake Formation')),
 ('hybrid',
  3,
  'Migración Híbrida',
  '9-16',
  ('Rehost componentes estables en EC2/RDS',
   'Replatform DB a Aurora',
   'Refactor módulos regulatorios en EKS')),
 ('hybrid',
  4,
  'Consolidación',
  '17-20',
  ('Unificación de arquitectura', 'Auditoría PCI-DSS', 'Documentación SOX')))
PROFILE_SANCTIONED_COUNTRIES = ('IR', 'KP', 'SY', 'CU', 'VE')
READINESS_TEXTS = (('cloud_readiness', None, None, None, 'Baja preparacion para nube', None),
 ('data_quality',
  'data_quality_score',
  '<',
  50,
  'Calidad de datos baja',
  'Calidad de datos media'),
 ('security_risk', None, None, None, 'Riesgo alto', None),
 ('compliance_risk', None, None, None, 'Riesgo alto', None),
 ('migration_risk', None, None, None, 'Riesgo alto', None),
 ('general', 'readiness_general', '<', 50, 'Readiness medio-bajo', 'Readiness medio'))
REGULATORY_TEXTS = (('regulatory_risk',
  'regulatory_risk_score',
  '>=',
  70,
  'Riesgo alto — remediación inmediata',
  'Riesgo medio — plan estructurado requerido'),
 ('pci_readiness',
  'pci_readiness_score',
  '<',
  40,
  'Insuficiente — controles PCI-DSS no implementados',
  'Parcial — gaps identificados'),
 ('sox_traceability',
  'sox_traceability_score',
  '<',
  40,
  'Insuficiente — audit trail incompleto',
  'Parcial — gaps de trazabilidad'),
 ('pii_exposure',
  'pii_exposure_score',
  '>=',
  70,
  'Alta exposición — PII en texto plano',
  'Exposición media'),
 ('encryption_coverage',
  'encryption_coverage_score',
  '<',
  40,
  'Insuficiente — cifrado no implementado',
  'Cobertura parcial'),
 ('auditability',
  'auditability_score',
  '<',
  40,
  'Insuficiente — evidencia de auditoría incompleta',
  'Auditabilidad parcial'),
 ('ofac_sanctions',
  'ofac_sanctions_score',
  '>',
  0,
  'CRÍTICO — transacciones con entidades sancionadas detectadas',
  'Sin hallazgos OFAC'),
 ('aml_risk',
  'aml_risk_score',
  '>',
  0,
  'CRÍTICO — patrones AML detectados',
  'Sin patrones AML'),
 ('dora_resilience',
  'dora_resilience_score',
  '>=',
  70,
  'Insuficiente — sin controles de resiliencia operacional',
  'Controles básicos presentes'))
RISKS = (('rehost',
  1,
  'Dependencias legacy no identificadas',
  'MEDIUM',
  'MEDIUM',
  'Discovery exhaustivo pre-migración'),
 ('replatform',
  1,
  'Incompatibilidad SQL Server → Aurora',
  'MEDIUM',
  'HIGH',
  'SCT assessment + pruebas de compatibilidad'),
 ('replatform',
  2,
  'Downtime durante cutover',
  'LOW',
  'HIGH',
  'Blue/green deployment con rollback automático'),
 ('refactor',
  1,
  'Scope creep en descomposición de monolito',
  'HIGH',
  'HIGH',
  'Bounded contexts definidos antes de iniciar'),
 ('refactor',
  2,
  'Regresiones funcionales',
  'MEDIUM',
  'HIGH',
  'Test suite completo pre-refactor'),
 ('refactor',
  3,
  'Resistencia del equipo al cambio',
  'MEDIUM',
  'MEDIUM',
  'Change management y capacitación temprana'),
 ('rebuild',
  1,
  'Pérdida de conocimiento del negocio',
  'HIGH',
  'HIGH',
  'Documentación exhaustiva del sistema legacy'),
 ('rebuild',
  2,
  'Overrun de presupuesto',
  'HIGH',
  'HIGH',
  'Sprints cortos con entregables medibles'),
 ('rebuild',
  3,
  'Operación paralela prolongada',
  'MEDIUM',
  'HIGH',
  'Strangler fig pattern para migración gradual'),
 ('hybrid',
  1,
  'Complejidad de integración entre componentes migrados y legacy',
  'HIGH',
  'MEDIUM',
  'API Gateway como capa de abstracción'),
 ('hybrid',
  2,
  'Inconsistencia de datos entre sistemas',
  'MEDIUM',
  'HIGH',
  'Event sourcing + DQ Engine continuo'))
RISK_CLASSES = (('HIGH',
  65,
  'Riesgo regulatorio alto — remediación inmediata requerida',
  'FAIL — observaciones materiales esperadas en PCI-DSS y SOX',
  'USD 60,000–1,200,000 / año'),
 ('MEDIUM',
  40,
  'Riesgo regulatorio medio — plan de remediación estructurado requerido',
  'OBSERVACIONES — gaps identificados, sin incumplimiento material inmediato',
  'USD 10,000–60,000 / año'),
 ('LOW',
  0,
  'Riesgo regulatorio bajo — controles básicos en lugar',
  'PASS con observaciones menores',
  'USD 0–10,000 / año'))
ROLE_RATES = (('arch', 200), ('devops', 150), ('data', 160), ('sec', 170), ('pm', 120))
ROLE_SHARES = (('rehost', 'arch', 0.5),
 ('rehost', 'devops', 1.0),
 ('rehost', 'data', 0.5),
 ('rehost', 'sec', 0.3),
 ('rehost', 'pm', 0.3),
 ('replatform', 'arch', 1.0),
 ('replatform', 'devops', 1.0),
 ('replatform', 'data', 0.75),
 ('replatform', 'sec', 0.5),
 ('replatform', 'pm', 0.5),
 ('refactor', 'arch', 1.0),
 ('refactor', 'devops', 1.0),
 ('refactor', 'data', 0.75),
 ('refactor', 'sec', 0.75),
 ('refactor', 'pm', 0.5),
 ('rebuild', 'arch', 1.0),
 ('rebuild', 'devops', 1.0),
 ('rebuild', 'data', 1.0),
 ('rebuild', 'sec', 1.0),
 ('rebuild', 'pm', 0.75),
 ('hybrid', 'arch', 1.0),
 ('hybrid', 'devops', 1.0),
 ('hybrid', 'data', 0.75),
 ('hybrid', 'sec', 0.5),
 ('hybrid', 'pm', 0.5))
SANCTIONED_COUNTRIES = ('IR', 'KP', 'SY', 'CU', 'VE', 'SD', 'MM', 'BY', 'RU')
SANCTIONED_CURRENCIES = ('IRR', 'KPW', 'SYP', 'CUP', 'VEF', 'SDG')
SCORE_DEFAULTS = {'cloud_readiness_score': 38,
 'data_quality_score': 76,
 'security_risk_score': 78,
 'compliance_risk_score': 74,
 'migration_risk_score': 72,
 'pci_readiness_score': 56,
 'sox_traceability_score': 89,
 'pii_exposure_score': 72,
 'encryption_coverage_score': 35,
 'auditability_score': 87,
 'regulatory_risk_score': 44}
SERVICES = (('rehost', 1, 'Amazon EC2'),
 ('rehost', 2, 'Amazon RDS for SQL Server'),
 ('rehost', 3, 'Amazon S3'),
 ('rehost', 4, 'AWS CloudTrail'),
 ('rehost', 5, 'AWS KMS'),
 ('rehost', 6, 'AWS Secrets Manager'),
 ('replatform', 1, 'Amazon Aurora PostgreSQL'),
 ('replatform', 2, 'Amazon EKS'),
 ('replatform', 3, 'Amazon S3'),
 ('replatform', 4, 'AWS Glue'),
 ('replatform', 5, 'AWS Lake Formation'),
 ('replatform', 6, 'AWS CloudTrail'),
 ('replatform', 7, 'AWS KMS'),
 ('replatform', 8, 'AWS Secrets Manager'),
 ('replatform', 9, 'Amazon Cognito'),
 ('replatform', 10, 'AWS Security Hub'),
 ('refactor', 1, 'Amazon Aurora PostgreSQL'),
 ('refactor', 2, 'Amazon EKS'),
 ('refactor', 3, 'Amazon S3'),
 ('refactor', 4, 'AWS Glue'),
 ('refactor', 5, 'AWS Lake Formation'),
 ('refactor', 6, 'AWS CloudTrail'),
 ('refactor', 7, 'AWS KMS'),
 ('refactor', 8, 'AWS Secrets Manager'),
 ('refactor', 9, 'Amazon Cognito'),
 ('refactor', 10, 'AWS Security Hub'),
 ('refactor', 11, 'AWS Audit Manager'),
 ('refactor', 12, 'Amazon Macie'),
 ('refactor', 13, 'AWS Control Tower'),
 ('rebuild', 1, 'Amazon Aurora PostgreSQL'),
 ('rebuild', 2, 'Amazon EKS'),
 ('rebuild', 3, 'Amazon API Gateway'),
 ('rebuild', 4, 'AWS Lambda'),
 ('rebuild', 5, 'Amazon S3'),
 ('rebuild', 6, 'AWS Glue'),
 ('rebuild', 7, 'AWS Lake Formation'),
 ('rebuild', 8, 'AWS CloudTrail'),
 ('rebuild', 9, 'AWS KMS'),
 ('rebuild', 10, 'AWS Secrets Manager'),
 ('rebuild', 11, 'Amazon Cognito'),
 ('rebuild', 12, 'AWS Security Hub'),
 ('rebuild', 13, 'AWS Audit Manager'),
 ('rebuild', 14, 'Amazon Macie'),
 ('rebuild', 15, 'AWS Control Tower'),
 ('rebuild', 16, 'Amazon EventBridge'),
 ('hybrid', 1, 'Amazon EC2'),
 ('hybrid', 2, 'Amazon Aurora PostgreSQL'),
 ('hybrid', 3, 'Amazon EKS'),
 ('hybrid', 4, 'Amazon S3'),
 ('hybrid', 5, 'AWS Glue'),
 ('hybrid', 6, 'AWS CloudTrail'),
 ('hybrid', 7, 'AWS KMS'),
 ('hybrid', 8, 'AWS Secrets Manager'),
 ('hybrid', 9, 'AWS Security Hub'),
 ('hybrid', 10, 'AWS Audit Manager'))
SERVICE_CATEGORIES = (('Amazon EC2', 'Compute'),
 ('Amazon Aurora PostgreSQL', 'Database'),
 ('Amazon EKS', 'Compute'),
 ('Amazon S3', 'Storage'),
 ('AWS Glue', 'Data'),
 ('AWS Lake Formation', 'Data'),
 ('AWS CloudTrail', 'Audit'),
 ('AWS KMS', 'Security'),
 ('AWS Secrets Manager', 'Security'),
 ('AWS Security Hub', 'Security'),
 ('AWS Audit Manager', 'Compliance'),
 ('Amazon Cognito', 'Identity'),
 ('Amazon Macie', 'Security'),
 ('AWS Control Tower', 'Governance'),
 ('AWS Config', 'Compliance'),
 ('Amazon CloudWatch', 'Operations'),
 ('Amazon Athena', 'Analytics'))
STATUSES = ('COMPLETED', 'PENDING', 'FAILED', 'PROCESSING', 'REVERSED', 'CANCELLED', 'CANCELED')
STRATEGIES = (('rehost',
  8,
  'LOW',
  1200,
  'Cloud Readiness Score insuficiente para lift-and-shift sin remediación previa de '
  'compliance'),
 ('replatform',
  16,
  'MEDIUM',
  900,
  'Nivel de deuda técnica y gaps regulatorios requieren mayor refactorización'),
 ('refactor',
  24,
  'MEDIUM-HIGH',
  800,
  'Complejidad y costo superiores al beneficio incremental sobre replatform'),
 ('rebuild',
  36,
  'HIGH',
  750,
  'Riesgo y costo de reconstrucción total no justificados dado el estado actual del sistema'),
 ('hybrid',
  20,
  'MEDIUM',
  950,
  'Estrategia unificada preferida para reducir complejidad operativa durante la migración'))
TEAMS = (('rehost', 1, 'Cloud Architect', '100%', 1),
 ('rehost', 2, 'DevOps Engineer', '100%', 1),
 ('rehost', 3, 'Project Manager', '50%', 1),
 ('replatform', 1, 'Cloud Architect', '100%', 1),
 ('replatform', 2, 'DevOps Engineer', '100%', 1),
 ('replatform', 3, 'Data Engineer', '75%', 1),
 ('replatform', 4, 'Security Engineer', '50%', 1),
 ('replatform', 5, 'Project Manager', '50%', 1),
 ('refactor', 1, 'Cloud Architect', '100%', 1),
 ('refactor', 2, 'DevOps Engineer', '100%', 1),
 ('refactor', 3, 'Data Engineer', '75%', 1),
 ('refactor', 4, 'Security Engineer', '75%', 1),
 ('refactor', 5, 'Compliance Analyst', '50%', 1),
 ('refactor', 6, 'Project Manager', '50%', 1),
 ('rebuild', 1, 'Cloud Architect', '100%', 1),
 ('rebuild', 2, 'DevOps Engineer', '100%', 2),
 ('rebuild', 3, 'Data Engineer', '100%', 1),
 ('rebuild', 4, 'Security Engineer', '100%', 1),
 ('rebuild', 5, 'Backend Developer', '100%', 2),
 ('rebuild', 6, 'Compliance Analyst', '75%', 1),
 ('rebuild', 7, 'Project Manager', '75%', 1),
 ('hybrid', 1, 'Cloud Architect', '100%', 1),
 ('hybrid', 2, 'DevOps Engineer', '100%', 1),
 ('hybrid', 3, 'Data Engineer', '75%', 1),
 ('hybrid', 4, 'Security Engineer', '50%', 1),
 ('hybrid', 5, 'Project Manager', '50%', 1))
TEAM_RATES = (('Cloud Architect', 200),
 ('DevOps Engineer', 150),
 ('Data Engineer', 160),
 ('Security Engineer', 170),
 ('Project Manager', 120))
WORKBOOK_DIMENSIONS = (('Cloud Readiness', 'cloud_readiness_score', True),
 ('Data Quality', 'data_quality_score', True),
 ('Security Risk', 'security_risk_score', False),
 ('Compliance Risk', 'compliance_risk_score', False),
 ('PCI-DSS Readiness', 'pci_readiness_score', True),
 ('SOX Traceability', 'sox_traceability_score', True),
 ('PII Exposure', 'pii_exposure_score', False),
 ('Encryption Coverage', 'encryption_coverage_score', True),
 ('Auditability', 'auditability_score', True),
 ('Regulatory Risk', 'regulatory_risk_score', False),
 ('Migration Complexity', 'migration_complexity_score', False))
