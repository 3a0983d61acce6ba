"""The compliance rules as data.

A line: id; standard; test; severity if the test fails; name. A test is made of terms joined by ``|`` or ``&``:

- ``type:a,b`` an event's type contains one of the words, in any case; ``entity:`` and ``user:`` likewise; ``action:`` equals one of them;
- ``total`` there are events; ``sample`` there are sampled events; ``protected`` there are events and all have a chain link;
- ``users times types ips origins actions`` every sampled event has a user, time, type, address, machine or assembly, action; ``ip correlation`` some event has one;
- ``recent:n`` some event in the last n hours; ``age>=n`` and ``age<=n`` days since the oldest event; ``config:entities`` and ``config:properties`` given by the caller.

``pass!`` before the test: the rule passes anyway, the test only sets the severity. Fixed values.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    standard: str
    test: str
    severity: str
    name: str


_LINES = """
C1; GDPR; total; Critical; Records of Processing (Article 30)
C2; GDPR; type:Consent; High; User Consent Tracking (Article 7)
C3; GDPR; type:DataAccess,PersonalData,View; High; Data Access Logging (Article 15)
C4; GDPR; type:Delete,Erasure,Anonymize; Medium; Right to Erasure Tracking (Article 17)
C5; GDPR; pass! type:Export,Download,Portability; Low; Data Portability Tracking (Article 20)
C6; GDPR; age<=2555; Medium; Data Retention Compliance (Article 5)
C7; GDPR; sample & users; High; User Identification (Article 32)
C8; GDPR; pass! total | pass; Info; Security Breach Tracking (Article 33)
C9; GDPR; type:DPIA,Assessment,RiskAssessment; Low; DPIA Documentation (Article 35)
C10; GDPR; protected; High; Audit Log Integrity Protection
C11; HIPAA; total; Critical; Audit Controls (§164.312(b))
C12; HIPAA; recent:720; High; Information System Activity Review (§164.308(a)(1)(ii)(D))
C13; HIPAA; type:PHI,Patient,Medical,Health,Record | entity:Patient; Critical; PHI Access Logging (§164.312(a)(1))
C14; HIPAA; sample & users; Critical; Unique User Identification (§164.312(a)(2)(i))
C15; HIPAA; type:Logoff,Logout,SessionEnd,Timeout; Medium; Automatic Logoff Tracking (§164.312(a)(2)(iii))
C16; HIPAA; protected; Critical; Integrity Controls (§164.312(c)(1))
C17; HIPAA; protected; Medium; Authentication Mechanism (§164.312(c)(2))
C18; HIPAA; type:Login,Authentication,SignIn,Failed,Denied; High; Log-in Monitoring (§164.308(a)(5)(ii)(C))
C19; HIPAA; pass! total | pass; Info; Security Incident Tracking (§164.308(a)(6)(ii))
C20; HIPAA; age>=1; Medium; Documentation Retention (§164.316(b)(1)(i))
C21; HIPAA; type:Authorization,Permission,Role,Access; Medium; Authorization Tracking (§164.308(a)(3)(ii)(A))
C22; HIPAA; pass! total | pass; Info; Emergency Access Procedures (§164.312(a)(2)(ii))
C23; SOC2; total; Critical; Access Control Logging (CC6.1)
C24; SOC2; type:Login,Authentication,SignIn; High; Authentication Logging (CC6.2)
C25; SOC2; type:User,Account,Permission,Role; High; Account Management Logging (CC6.3)
C26; SOC2; sample & users; Critical; User Identification (CC6.6)
C27; SOC2; pass! total | pass; Info; Security Event Detection (CC7.2)
C28; SOC2; recent:720; Medium; Security Event Evaluation (CC7.3)
C29; SOC2; type:Response,Remediation,Investigation | none:Security,Incident,Threat,Breach,Alert; Info; Incident Response Tracking (CC7.4)
C30; SOC2; type:Change,Deploy,Release,Configuration | action:Modified; Medium; Change Management Logging (CC8.1)
C31; SOC2; type:Admin,Privileged,Root | user:admin; High; Privileged Access Monitoring (CC6.7)
C32; SOC2; type:Health,Performance,Availability,Uptime; Low; System Availability Monitoring (A1.2)
C33; SOC2; type:Data,Confidential,Sensitive,Export; Low; Confidential Data Access (C1.2)
C34; SOC2; age>=365; Medium; Audit Log Retention
C35; SOC2; protected; High; Audit Log Integrity Protection
C36; ISO27001; total; Critical; Event Logging (A.12.4.1)
C37; ISO27001; protected; High; Log Protection (A.12.4.2)
C38; ISO27001; type:Security,Incident,Breach; High; Security Event Reporting (A.16.1.2)
C39; ISO27001; type:User,Login,Access; Medium; User Access Management (A.9.2.1)
C40; ISO27001; type:Admin | user:admin; Medium; Administrator Activity Logging (A.12.4.3)
C41; ISO27001; sample & times; Medium; Clock Synchronization (A.12.4.4)
C42; ISO27001; age>=90; Low; Log Retention Requirements
C43; PCI_DSS; total; Critical; Audit Logs Implementation (Req 10.2)
C44; PCI_DSS; type:Card,Payment,CHD,PAN | entity:Payment,Card; High; Cardholder Data Access Logging (Req 10.2.1)
C45; PCI_DSS; type:Admin,Privileged,Root,Sudo | user:admin,root; High; Privileged User Actions (Req 10.2.2)
C46; PCI_DSS; type:Audit,Log; Medium; Audit Trail Access Logging (Req 10.2.3)
C47; PCI_DSS; pass! total | pass; Info; Invalid Access Attempts (Req 10.2.4)
C48; PCI_DSS; type:Password,Credential,Authentication,User; High; Authentication Changes (Req 10.2.5)
C49; PCI_DSS; total; Medium; Audit Log Initialization (Req 10.2.6)
C50; PCI_DSS; type:Create,Delete | action:Added,Deleted; Medium; System Object Changes (Req 10.2.7)
C51; PCI_DSS; sample & users & times; Critical; Audit Log Detail Requirements (Req 10.3)
C52; PCI_DSS; recent:1; Medium; Time Synchronization (Req 10.3.4)
C53; PCI_DSS; protected; Critical; Audit Log Protection (Req 10.4)
C54; PCI_DSS; age>=365; High; Audit Log Retention (Req 10.5)
C55; PCI_DSS; recent:1; Info; Regular Log Review (Req 10.6)
C56; PCI_DSS; pass! total | pass; Info; Security Control Failure Detection (Req 10.7)
C57; FERPA; config:entities; High; FERPA Entity Configuration (§99.31)
C58; FERPA; config:properties; High; FERPA Sensitive Data Protection (§99.31)
C59; FERPA; type:Student,Education,Record,Enrollment,Grade,Transcript; High; Education Records Access Logging (§99.10)
C60; FERPA; sample & users; Critical; Unique User Identification (§99.31(a))
C61; FERPA; type:Consent,ParentConsent,Authorization; Medium; Prior Written Consent Tracking (§99.30)
C62; FERPA; type:DirectoryOptOut,OptOut,DirectoryInfo; Medium; Directory Information Opt-Out (§99.37)
C63; FERPA; type:LegitimateInterest,AccessJustification,EducationalPurpose; Medium; Legitimate Educational Interest (§99.31(a)(1))
C64; FERPA; type:Disclosure,DataSharing,ThirdParty; Medium; Disclosure Logging (§99.32)
C65; FERPA; type:FerpaNotification,AnnualNotice,RightsNotification; Low; Annual Notification (§99.7)
C66; FERPA; total; Medium; Retention Compliance (§99.32(a)(2))
C69; FERPA; protected; Critical; Integrity Controls
C70; FERPA; none:Research,Study | type:DeIdentified,Anonymized; Medium; De-identification for Research (§99.31(b))
C72; FERPA; pass! total | pass; Info; Security Incident Tracking
C73; FERPA; type:Login,Authentication,SignIn,Failed,Denied; High; Login/Authentication Monitoring
C74; STIG; total; Critical; Audit Generation (V-222582 / AU-12)
C75; STIG; sample & users & times & types; Critical; Content of Audit Records (V-222576 / AU-3)
C76; STIG; sample & ips & origins & actions; High; Additional Audit Information (V-222577 / AU-3(1))
C77; STIG; sample & times; High; Time Stamps (V-222578 / AU-8)
C78; STIG; protected; Critical; Protection of Audit Information (V-222579 / AU-9)
C79; STIG; type:Archive,Backup,Export; Medium; Audit Backup to Separate System (V-222580 / AU-9(2))
C80; STIG; age>=365; High; Audit Record Retention (V-222581 / AU-11)
C81; STIG; correlation; Medium; System-Wide Audit Trail (V-222583 / AU-12(1))
C82; STIG; both:logon,object; High; Auditable Events (V-222569 / AU-2)
C83; STIG; recent:720; Medium; Reviews of Auditable Events (V-222570 / AU-2(3))
C84; STIG; type:Admin,Privileged,Root,Sudo,Elevat | user:admin; High; Privileged Function Execution (V-222574 / AU-3)
C85; STIG; type:Account,UserCreate,UserDelete,UserDisable,UserEnable,Registration | account; High; Account Management (V-222534 / AC-2)
C86; STIG; pass! type:FailedLogin,LoginFailed,AuthenticationFailed,FailedAuthentication,Denied,Lockout,AccountLocked; Medium; Unsuccessful Logon Attempts (V-222542 / AC-7)
C87; STIG; type:Banner,SystemUse,Consent,TermsAccepted,Disclaimer; High; System Use Notification (V-222543 / AC-8)
C88; STIG; type:Remote,VPN,SSH,RDP,API | ip; High; Remote Access (V-222553 / AC-17)
C89; STIG; pass! total | pass; Info; Information System Monitoring (SI-4)
C90; STIG; type:Password,Credential,MFA,Token,Certificate,CAC,PKI; Medium; Authenticator Management (IA-5)
"""

RULES = [Rule(*(x.strip() for x in line.split(";"))) for line in _LINES.strip().splitlines()]
#: What auditable events are (C82): a logon and an object access must both occur; with fewer than four groups the severity is Medium.
EVENT_GROUPS = {
    "logon": ("Login", "Logon", "SignIn", "Authentication"),
    "logoff": ("Logout", "Logoff", "SignOut", "SessionEnd"),
    "privilege": ("Admin", "Privileged", "Role", "Permission", "Sudo", "Elevat"),
    "object": ("Create", "Update", "Delete", "Access"),
    "policy": ("Policy", "Configuration", "Setting"),
}
#: Actions that count as object access beside the words (C82), and as account changes of a user entity.
CHANGES = ("Added", "Modified", "Deleted")
SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")
