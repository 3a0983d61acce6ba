"""Enumerations of the audit data model. Fixed values, in the order of their numbers."""

AUDIT_ACTION = {1: "Created", 2: "Updated", 3: "Deleted", 4: "StatusChanged", 5: "Assigned", 6: "Unassigned", 7: "Commented", 8: "Attached", 9: "Unknown", 10: "Imported", 11: "Exported", 12: "Viewed"}
INTEGRITY_STATUS = {1: "Pending", 2: "Completed", 3: "Failed", 4: "Reconciled"}
OUTBOX_STATUS = {0: "Pending", 1: "InFlight", 2: "Completed", 3: "Failed"}
ARCHIVE_STATUS = {0: "InProgress", 1: "Completed", 2: "Failed", 3: "Corrupted"}
SEVERITY = {0: "Info", 1: "Low", 2: "Medium", 3: "High", 4: "Critical"}
SUBJECT_STORE = {1: "AuditEvent", 2: "AuditLog", 3: "SecurityEvent"}
FIELD_TREATMENT = {0: "Audit", 1: "Mask", 2: "Encrypt", 3: "Omit"}
COMPLIANCE_STANDARD = ("GDPR", "SOC2", "HIPAA", "ISO27001", "FERPA", "PCI_DSS", "STIG", "NIST")

#: Row limits of the query surface, all of them defaults of parameters.
PAGE_DEFAULT, PAGE_MAX = 50, 1000
DISTINCT_MAX = 500
CHART_MAX = 100_000
EXPORT_MAX = 50_000
SUBJECT_MAX = 100_000
SAMPLE_MAX = 5_000
