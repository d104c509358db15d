"""Expected keyword lists and texts, written out so that a changed rule shows in the check."""

# Fixed values.
CATEGORY_KEYWORDS = {'Application Access': ['access', 'permission', 'login', 'sso', 'certif', 'account lock', 'badge', 'role',
                        'authoris', 'unauthor'],
 'Application Error': ['error', 'not working', 'crash', 'issue', 'problem', 'bug', 'giving an error', 'went wrong',
                       'failed', 'failure', 'cannot', "can't", 'unable', 'not running', 'not able'],
 'Data & Reporting': ['report', 'data fetch', 'letter generation', 'validation', 'document', 'upload', 'download',
                      'export', 'cycle count'],
 'User Account': ['new user', 'onboard', 'leaver', 'deactivat', 'profile', 'user setup', 'joiner'],
 'Network': ['vpn', 'wifi', 'network', 'internet', 'connect', 'dns', 'bandwidth', 'proxy', 'connectivity'],
 'Hardware': ['laptop', 'desktop', 'printer', 'monitor', 'mobile', 'device', 'hardware', 'screen', 'docking'],
 'Software & Tools': ['install', 'software', 'upgrade', 'patch', 'license', 'version', 'update', 'app update',
                      'workday', 'sap', 'sharepoint'],
 'Infrastructure': ['server', 'storage', 'backup', 'database', 'infrastructure', 'cpu', 'memory', 'disk', 'vm',
                    'virtual'],
 'Change Request': ['change request', 'enhancement', 'change/enhancement', 'product backlog', 'feature request'],
 'Service Request': ['request', 'provision', 'setup', 'new', 'require', 'materials management',
                     'generic technical']}
CATEGORY_KEYWORDS_IMPORT = {'Application Access': ['access', 'permission', 'login', 'sso', 'certif', 'badge', 'account lock', 'role'],
 'Application Error': ['error', 'not working', 'crash', 'issue', 'problem', 'bug', 'failed', 'cannot', 'unable'],
 'Data & Reporting': ['report', 'data', 'letter', 'validation', 'document', 'upload', 'export', 'cycle count'],
 'User Account': ['new user', 'onboard', 'leaver', 'deactivat', 'profile', 'user setup'],
 'Network': ['vpn', 'wifi', 'network', 'internet', 'connect', 'dns', 'bandwidth'],
 'Hardware': ['laptop', 'desktop', 'printer', 'monitor', 'mobile', 'device', 'screen'],
 'Software & Tools': ['install', 'software', 'upgrade', 'patch', 'license', 'version', 'update', 'sap',
                      'sharepoint'],
 'Infrastructure': ['server', 'storage', 'backup', 'database', 'cpu', 'memory', 'vm'],
 'Service Request': ['request', 'provision', 'setup', 'require']}
SUBCATEGORY_KEYWORDS = {'Application Access': [('Login/SSO', ['login', 'sso', 'sign in']),
                        ('Permission Error', ['permission', 'access denied', 'unauthor']),
                        ('Certification Required', ['certif']), ('Account Lockout', ['lock', 'locked']),
                        ('Badge Access', ['badge'])],
 'Application Error': [('Functional Error', ['error', 'not working', 'wrong']),
                       ('Performance Issue', ['slow', 'timeout', 'hang']),
                       ('Crash/Unresponsive', ['crash', 'unresponsive', 'freeze'])],
 'Data & Reporting': [('Data Fetch Issue', ['fetch', 'data', 'report']),
                      ('Document Upload', ['upload', 'document']), ('Validation Error', ['validation', 'reject'])],
 'Software & Tools': [('Application Update', ['update', 'upgrade', 'version']), ('Installation', ['install']),
                      ('License Issue', ['license'])]}
AUDIT_P1_KEYWORDS = ['complete failure', 'total outage', 'entire', 'all users', 'most users', 'division', 'production down',
 'no workaround', 'month-end', 'year-end', '500,000', '$500k', 'critical outage', 'cannot access', 'system down']
AUDIT_P2_KEYWORDS = ['senior management', 'significant', 'multiple users', 'many users', 'cannot generate', 'report failure',
 'time-sensitive', 'critical report', '50,000', '$50k', 'major issue', 'impacting operations']
AUDIT_P4_KEYWORDS = ['how do i', 'how to', 'inquiry', 'question', 'request', 'access request', 'workaround', 'information', 'guidance',
 'one user', 'single user']
REASONS = {'p1_ok': 'Description contains P1 indicators (widespread impact, no workaround).',
 'p1_to_2': 'Description lacks P1 breadth (no full-division outage, no $500K+ impact). Fits P2 better.',
 'p1_to_3': 'Description appears to describe a limited-scope issue, not qualifying for P1.',
 'p2_ok': 'Description contains P2 indicators (significant user impact, critical process).',
 'p2_to_4': 'Description appears to be an isolated/informational request, not P2.',
 'p2_to_3': 'Description describes a limited-scope issue. Consider P3 (limited users, recurring).',
 'other': 'Insufficient keywords to determine reclassification.'}
# End of fixed values.
