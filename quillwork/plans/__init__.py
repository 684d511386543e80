"""quillwork.plans"""
